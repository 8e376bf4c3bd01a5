"""Byte-level BPE as a streaming transducer with bounded lookahead, and the decoder back to text.

The encoder does not apply merges over a whole word.  It keeps, for every byte position, the last token of
the encoding of the word up to there.  That token is unique: of the vocabulary's tokens that end at the
position it is the one that can follow the encoding before it, and whether two tokens can stand side by side
depends on these two alone (merging their joined bytes must give the pair back).  How many bytes after a
token can still change it is computed from the merge list (``sufficient_lookahead``; 119 for the default
vocabulary): a boundary with so many bytes behind it is final, so the tokens before it are emitted and forgotten.
Memory stays constant however long a word is.

Short words repeat, so their encodings are kept in a bounded table.  A long text is scanned as a stream: at
most WORDS_AT_ONCE of its words and their ids are held.  Documents are independent: no shuffle.
The vocabulary file is a parameter; by default that of the public tokenizers package, read where it is installed on each worker.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"
#: How a text is split into words before merging (fixed by the vocabulary); white space is spelled out, since engines differ in it.
SPACES = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The same for texts of Latin-1 characters only, where letters and numbers can be listed; about twice as fast.
LETTERS, NUMBERS, LATIN_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0"
LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{LATIN_SPACES}{LETTERS}{NUMBERS}]+|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+")
#: Words longer than this many characters are streamed, shorter ones kept in the table.
SHORT = 40
TABLE = 250_000
#: Characters of short texts whose words are looked up together; a text of more is streamed.
TOGETHER = 1 << 20
#: Words of a streamed text that are looked up together, and characters of a long word that are taken at once.
WORDS_AT_ONCE, PIECE = 1 << 16, 1 << 16
#: Token ids that the decoder takes at once.
STEP = 1 << 14


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(rank: dict[tuple[int, int], tuple[int, int]], size: dict[int, int]) -> int:
    """Bytes after a token's end that decide whether it stays: a bound over all chains of merges.

    Merge (x, c) takes x away only if c stands behind it and has not itself been taken by an earlier merge with what follows, which
    needs c's bytes and all that this earlier merge needs, and so on with falling ranks.  A token is also made of others, so whether
    it stands there depends in the same way on its last part when that was merged.  One pass over the merges by rank.
    """
    taken: dict[int, int] = {}  # token -> bytes that tell whether a merge so far takes it with what follows
    made: dict[int, int] = {}  # token -> bytes that tell whether a merge so far makes it
    need = lambda token: max(taken.get(token, 0), made.get(token, 0))
    for (x, c), (_, token) in sorted(rank.items(), key=lambda item: item[1]):
        behind = need(c)
        taken[x] = max(taken.get(x, 0), size[c] + behind)
        made[token] = max(made.get(token, 0), behind)
    return max(map(need, size), default=0)


class Merges:
    """The vocabulary and its merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letter = byte_letters()
        to_bytes = lambda s: bytes(letter[c] for c in s)
        model = file["model"]
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = map(to_bytes, m.split(" ") if isinstance(m, str) else m)
            self.rank[self.ids[a], self.ids[b]] = (k, self.ids[a + b])
        self.longest = max(map(len, self.ids))
        self.lookahead = sufficient_lookahead(self.rank, {i: len(b) for b, i in self.ids.items()})
        #: All endings of tokens: a search to the left from some position stops where the bytes are none.
        self.endings = {b[k:] for b in self.ids for k in range(len(b))}
        self._beside: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first; used on the bytes of one or two tokens only."""
        word = [self.ids[raw[k : k + 1]] for k in range(len(raw))]
        while len(word) > 1:
            (_, new), at = min(((self.rank.get(pair, (1 << 60, -1)), k) for k, pair in enumerate(zip(word, word[1:]))), default=((0, -1), 0))
            if new < 0:
                break
            pair, out, k = (word[at], word[at + 1]), [], 0
            while k < len(word):
                if k + 1 < len(word) and (word[k], word[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(word[k])
                    k += 1
            word = out
        return word

    def whole(self, token: int) -> bool:
        """Whether merging a token's bytes gives that token."""
        if (found := self._whole.get(token)) is None:
            found = self._whole[token] = self.merged(self.bytes[token]) == [token]
        return found

    def beside(self, a: int, b: int) -> bool:
        """Whether b can follow a."""
        if (found := self._beside.get((a, b))) is None:
            if len(self._beside) >= TABLE:
                self._beside.clear()
            found = self._beside[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def extend(self, raw: bytes, at: int, last: list[int], before: int = -1) -> None:
        """Append the last token of the encoding up to each position after ``at`` to ``last`` (-2: none ends there)."""
        endings, ids, known, whole = self.endings, self.ids, self._beside, self.whole
        for end in range(at + 1, len(raw) + 1):
            start = end - 1
            while start > 0 and raw[start - 1 : end] in endings:
                start -= 1
            while start < end:
                token = ids.get(raw[start:end])
                if token is not None and whole(token):
                    previous = last[start - 1] if start else before
                    if previous == -1:
                        break
                    if previous >= 0:
                        fits = known.get((previous, token))
                        if self.beside(previous, token) if fits is None else fits:
                            break
                start += 1
            else:
                token = -2
            last.append(token)


class WordEncoder:
    """Encodes one word that arrives in pieces; ``feed`` returns the tokens that have become stable."""

    def __init__(self, merges: Merges):
        self.merges, self.raw, self.last, self.before = merges, b"", [], -1
        #: Bytes held before stable tokens are looked for: several times what has to stay, so that each byte is looked at a few times only.
        self.due = 4 * (merges.lookahead + merges.longest)

    def _take(self, end: int, stable: int) -> list[int]:
        """The tokens of the encoding up to ``end`` that end at ``stable`` or before; they and their bytes are forgotten."""
        out, cut = [], 0
        while end > 0:
            token = self.last[end - 1]
            if end <= stable:
                cut = cut or end
                out.append(token)
            end -= len(self.merges.bytes[token])
        if out:
            self.before = out[0]
            self.raw, self.last = self.raw[cut:], self.last[cut:]
        return out[::-1]

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(piece), self.due):
            at, self.raw = len(self.raw), self.raw + piece[k : k + self.due]
            self.merges.extend(self.raw, at, self.last, self.before)
            if len(self.raw) >= self.due:
                out += self._take(len(self.raw), len(self.raw) - self.merges.lookahead)
        return out

    def finish(self) -> list[int]:
        return self._take(len(self.raw), len(self.raw))


class Codec:
    """Text to ids and back."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        #: word -> its ids as little-endian 32-bit numbers; bounded.
        self.table: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> list[str]:
        """Put words into the table; returns the long ones, which are not to stay there. In sorted order a word starts like the one before, so the transducer goes on from where they part."""
        long, size = [], self.merges.bytes
        raw, last = b"", []
        for word in sorted(words):
            new = word.encode("utf-8")
            if len(word) > SHORT:
                encoder = WordEncoder(self.merges)
                self.table[word] = np.array(encoder.feed(new) + encoder.finish(), "<u4").tobytes()
                long.append(word)
                continue
            same, most = 0, min(len(raw), len(new))
            while same < most and raw[same] == new[same]:
                same += 1
            del last[same:]
            self.merges.extend(new, same, last)
            raw, end, out = new, len(new), []
            while end:
                token = last[end - 1]
                out.append(token)
                end -= len(size[token])
            self.table[word] = np.array(out[::-1], "<u4").tobytes()
        return long

    def _pattern(self, text: str):
        latin = text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)
        return LATIN_WORDS if latin else WORDS

    def _mark(self, special: str) -> bytes:
        return np.array([self.merges.special[special]], "<u4").tobytes() if special else b""

    def _looked_up(self, lists: Iterable[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        lists = list(lists)
        words = set(chain.from_iterable(lists))
        if len(self.table) + len(words) > TABLE:
            self.table.clear()
        long = self._learn(words.difference(self.table))
        out = [b"".join(map(self.table.__getitem__, some)) for some in lists]
        for word in long:
            del self.table[word]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids per text as little-endian unsigned 32-bit numbers, for texts that are short together. Special tokens that stand in a text are taken as such."""
        parts = [list(self._split(text)) for text in texts]
        ids = iter(self._looked_up(self._pattern(piece).findall(piece) for part in parts for _, piece in part))
        return [b"".join([self._mark(special) + next(ids) for special, _ in part]) for part in parts]

    def pieces(self, text: str) -> Iterator[bytes]:
        """The same for one text, in pieces: neither its words nor its ids are ever held all at once."""
        for special, part in self._split(text):
            yield self._mark(special)
            words: list[str] = []
            for m in self._pattern(part).finditer(part):
                if (long := m.end() - m.start() > SHORT) or len(words) >= WORDS_AT_ONCE:
                    yield from self._looked_up([words])
                    words = []
                if not long:
                    words.append(m[0])
                    continue
                encoder = WordEncoder(self.merges)
                for at in range(m.start(), m.end(), PIECE):
                    yield np.array(encoder.feed(part[at : min(at + PIECE, m.end())].encode("utf-8")), "<u4").tobytes()
                yield np.array(encoder.finish(), "<u4").tobytes()
            yield from self._looked_up([words])

    def _split(self, text: str) -> Iterator[tuple[str, str]]:
        """Parts of a text, each with the special token before it."""
        if not any(x in text for x in self.merges.special):
            yield "", text
            return
        at, before = 0, ""
        for m in self.merges.specials.finditer(text):
            yield before, text[at : m.start()]
            before, at = m[0], m.end()
        yield before, text[at:]

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Pieces of the text of ids that come in pieces: token bytes go through an incremental UTF-8 state machine, so a character may span tokens."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.bytes
        for piece in ids:
            for k in range(0, len(piece), 4 * STEP):
                yield machine.decode(b"".join(map(table.__getitem__, np.frombuffer(piece[k : k + 4 * STEP], "<u4").tolist())))
        yield machine.decode(b"", True)


@lru_cache(2)
def codec_of(path: str | None) -> Codec:
    """One per worker process, with its table."""
    return Codec(path or default_vocabulary())


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """Texts that are short together; a text above TOGETHER is alone."""
    group, size = [], 0
    for text in column:
        text = text.as_py() or ""
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


class _Result:
    """What is told of one text, from its ids as they come."""

    def __init__(self, codec: Codec, pieces: Iterable[bytes], with_ids: bool):
        self.n, ids, decoded, self.ids = 0, hashlib.sha256(), hashlib.sha256(), []

        def passed() -> Iterator[bytes]:
            for piece in pieces:
                self.n += len(piece) // 4
                ids.update(piece)
                if with_ids:
                    self.ids.append(piece)
                yield piece

        for piece in codec.decode(passed()):
            decoded.update(piece.encode("utf-8"))
        self.ids_sha256, self.decoded_sha256 = ids.hexdigest(), decoded.hexdigest()


def _encode(batches: Iterable[pa.RecordBatch], path: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = codec_of(path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    for batch in batches:
        at = 0
        for group in _groups(batch.column("text")):
            encoded = [codec.pieces(group[0])] if len(group[0]) > TOGETHER else [[raw] for raw in codec.encode_all(group)]
            results = list(map(_Result, repeat(codec), encoded, repeat(with_ids)))
            counts = [r.n for r in results]
            columns = [batch.column("doc_id").slice(at, len(group)), pa.array(counts, pa.int64()), pa.array([r.ids_sha256 for r in results], pa.string()), pa.array([r.decoded_sha256 for r in results], pa.string())]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                raw = b"".join(chain.from_iterable(r.ids for r in results))
                columns.append(pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(raw)])))
            at += len(group)
            yield pa.RecordBatch.from_arrays(columns, names)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    Null and empty texts have no tokens. Rows that repeat are encoded each, with equal results; there are no ties to break. A very long text is encoded
    as a stream by the task that reads it; only its ``ids``, if asked for, are one value. An empty table gives no rows. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lambda batches: _encode(batches, path, with_ids), schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; a null list gives an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = ["".join(codec.decode([np.array(x.as_py() or [], "<u4").tobytes()])) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
