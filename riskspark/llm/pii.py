"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, URL schemes, plus signs,
digits and identifier cues such as ``iban``.  Deterministic local parsers then grow
each anchor to the left and right and check what they find (address ranges, digit counts, Luhn and ISO 7064 check
digits).  A text without anchors costs that one pass.  Documents are independent: no shuffle.

Kinds: email, ip, card, phone (the base, leftmost and non-overlapping per kind, failing matches dropped without a retry), then
what the method adds: url (after a scheme), iban (checked), account (the value given after a cue).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import documents

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
SCHEMES = ("http://", "https://", "ftp://")
ASCII_LOW = {c: c + 32 for c in range(65, 91)}
CUES = ("iban", "account", "passport", "ssn", "token", "password", "api_key", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"'`|]*)?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])")
GIVEN = re.compile(r"[\x20\t]*(?:number|no\.?|#)?[\x20\t]*[:=#][\x20\t]*[\"']?([A-Za-z0-9][A-Za-z0-9_/+-]{5,})", re.IGNORECASE)


def automaton() -> ahocorasick.Automaton:
    """Anchor (in lower case) -> kind of anchor."""
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text in lower case with every character in its place; only A-Z where the whole case mapping would move some."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(ASCII_LOW)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_ok(raw: str) -> bool:
    turned = raw[4:] + raw[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban(text: str, at: int) -> re.Match | None:
    """The longest checked number at ``at`` that ends with a word: the match may run on into the words behind it."""
    end = len(text)
    while m := IBAN.match(text, at, end):
        if iban_ok(m[0].replace(" ", "")):
            return m
        end = at + m[0].rfind(" ")
        if end < at:
            break
    return None


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    start = at
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order; code point offsets, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # per kind, where the next match may start
    for last, (kind, size) in anchors.iter(lowered(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= done["ip"] and (m := ADDRESS.match(text, at)):
                done["ip"] = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                    out["ip"].append(m.span())
            elif at >= done["ip"]:  # the rest of this run of digits starts no address either
                end = at + 1
                while end < len(text) and text[end] in DIGITS:
                    end += 1
                done["ip"] = end
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = re.sub("[^0-9]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            if found := _email(text, at, done["email"]):
                out["email"].append(found)
                done["email"] = found[1]
        elif kind == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            if at >= done["url"] and (m := URL.match(text, last + 1)):
                out["url"].append((at, m.end()))
                done["url"] = m.end()
        elif kind == "cue":
            if at and text[at - 1].isalnum() or last + 1 < len(text) and text[last + 1].isalnum():
                continue
            near = re.compile(r"[\x20\t:=#]*").match(text, last + 1).end()
            if text[at : last + 1].lower() == "iban":
                m = _iban(text, near) if near >= done["iban"] else None
                if m:
                    out["iban"].append(m.span())
                    done["iban"] = m.end()
            elif (m := GIVEN.match(text, last + 1)) and m.start(1) >= done["account"] and any(c in DIGITS for c in m[1]):
                out["account"].append(m.span(1))
                done["account"] = m.end(1)
    return out


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = find(text.as_py() or "", anchors)
            spans = [f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]]
            base = spans[: sum(len(found[k]) for k in KINDS[:4])]
            rows.append((*(len(found[k]) for k in KINDS), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)))
        counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(KINDS))]
        texts = [pa.array([r[k] for r in rows], pa.string()) for k in (-2, -1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *texts], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, a count per kind, ``base_sha256`` and ``spans`` (``kind:start:end``, comma-joined).

    Null and empty texts have no spans. Repeated rows are scanned each. An empty table gives no rows. Other columns are not read.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            out = []
            for x in batch.column("text"):
                text, at, parts = x.as_py() or "", 0, []
                for a, b, k in sorted((a, -b, k) for k, spans in find(text, anchors).items() for a, b in spans):
                    if a >= at:
                        parts += [text[at:a], f"<{k}>"]
                    at = max(at, -b)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
