"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

Leaves are pieces of a line: sentences, cut behind PIECE_WORDS words.  A paragraph is the pieces of a line (a very long line is also cut,
behind pieces whose digest hits a pattern).  A section is consecutive paragraphs up to one whose digest hits a pattern, so its borders follow
the text and an edit moves only those around it.  The digest of a paragraph is that of its leaves' digests, a section's that of its paragraphs',
the root's that of its sections', each of 128 bits; pieces cover the whole text, so equal roots mean equal texts.  Where roots differ, equal
sections and then equal paragraphs are skipped as a whole and only differing branches are walked, which locates the edits.

A fingerprint is text: ``root/section:paragraph leaves,paragraph leaves/section:...`` in URL-safe base64, where only the root has its whole digest;
sections are written with 48 bits, paragraphs with 36, leaves with 24.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import documents

PIECE_WORDS = 12
#: A piece ends behind a sentence mark or a line break, or behind PIECE_WORDS words.
PIECES = re.compile(r"(?:[^\s.!?]+[^\S\n]*){1,%d}[\s.!?]*|[\s.!?]+" % PIECE_WORDS)
#: Characters of a section, a paragraph and a leaf in a fingerprint.
SECTION, PARAGRAPH, LEAF = 8, 6, 4
#: One paragraph in 4 ends a section; one leaf in 16 ends a paragraph, wherever the line ends.
LAST_OF_SECTION, LAST_OF_PARAGRAPH = 4, 16


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _shown(digest: bytes, size: int) -> str:
    return base64.urlsafe_b64encode(digest[:12]).decode()[:size]


def fingerprint(text: str) -> str:
    """The serialised tree of a whole text; an empty text has a root only."""
    sections, paragraphs, leaves = [], [], []  # (digest, shown); paragraphs and leaves of the section and the paragraph at hand
    pieces = PIECES.findall(text)
    for k, piece in enumerate(pieces, 1):
        leaf = _digest(piece.encode("utf-8", "surrogatepass"))
        leaves.append((leaf, _shown(leaf, LEAF)))
        end = k == len(pieces)
        if end or "\n" in piece or leaf[-1] % LAST_OF_PARAGRAPH == 0:
            node = _digest(b"".join(d for d, _ in leaves))
            paragraphs.append((node, _shown(node, PARAGRAPH) + "".join(x for _, x in leaves)))
            leaves = []
            if end or node[-1] % LAST_OF_SECTION == 0:
                node = _digest(b"".join(d for d, _ in paragraphs))
                sections.append((node, f"{_shown(node, SECTION)}:{','.join(x for _, x in paragraphs)}"))
                paragraphs = []
    root = base64.urlsafe_b64encode(_digest(b"".join(d for d, _ in sections))).decode().rstrip("=")
    return "/".join([root, *(x for _, x in sections)])


def parse(mark: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """Root, and sections as (digest, [(paragraph digest, leaves)])."""
    root, *sections = mark.split("/")
    leaves = lambda p: [p[k : k + LEAF] for k in range(PARAGRAPH, len(p), LEAF)]
    return root, [(s[:SECTION], [(p[:PARAGRAPH], leaves(p)) for p in s[SECTION + 1 :].split(",")]) for s in sections]


def _unmatched(left: list[tuple], right: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The nodes of each side without a partner of the same digest on the other one."""
    both = Counter(d for d, _ in left) & Counter(d for d, _ in right)
    rest = []
    for side in (left, right):
        room = Counter(both)
        rest.append([])
        for node in side:
            if room[node[0]]:
                room[node[0]] -= 1
            else:
                rest[-1].append(node)
    return rest[0], rest[1]


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common (Dice, with repetitions): 1 for equal roots, 0 for nothing in common."""
    (root_a, left), (root_b, right) = parse(a), parse(b)
    if root_a == root_b:
        return 1.0
    total = sum(len(x) for side in (left, right) for _, section in side for _, x in section)
    if not total:
        return 0.0
    left, right = _unmatched(left, right)
    left, right = _unmatched([p for _, section in left for p in section], [p for _, section in right for p in section])
    left, right = (Counter(x for _, p in side for x in p) for side in (left, right))
    return (total - (left - right).total() - (right - left).total()) / total


def edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """What ``b`` lacks of ``a``: (section number, paragraph number in it, number of its leaves that are not in ``b``)."""
    (root_a, left), (root_b, right) = parse(a), parse(b)
    if root_a == root_b:
        return []
    sections, paragraphs = {d for d, _ in right}, {d for _, section in right for d, _ in section}
    leaves = {x for _, section in right for _, p in section for x in p}
    return [(i, j, sum(x not in leaves for x in p)) for i, (d, section) in enumerate(left) if d not in sections for j, (e, p) in enumerate(section) if e not in paragraphs]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` per row. Null and empty texts have a root only; repeated rows and ties get equal fingerprints. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t.as_py() or "") for t in batch.column("text")], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and order; a bucket ends with the rows of the id that follows it (``halo``)."""
    held, names = None, [f.split()[0] for f in SCHEMA.split(", ")]

    def pair(current: tuple, following: tuple) -> tuple:
        _, _, doc_id, text, mark = current
        n, quarter = len(text), len(text) // 4
        edited = text[: n - quarter] + following[3][:quarter]
        edited_mark = mark if edited == text else fingerprint(edited)
        return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following[4])

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            out, part = [], batch.slice(a, 256)
            for row in zip(*(part.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")), strict=True):
                if held is not None and held[0] == row[0] and held[1] and row[1]:
                    continue  # one row after the bucket is enough
                row = (*row[:3], row[3] or "", "")
                row = (*row[:4], fingerprint(row[3]))
                if held is not None and not held[1]:
                    out.append(pair(held, row if held[0] == row[0] else held))
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)
    if held is not None and not held[1]:
        out = [pair(held, held)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter comes from the next document by id.

    Columns: see SCHEMA. Null texts count as empty. Order: id (null first), then text; rows that repeat an id follow each other. The
    last row's next is the first row; a table with one row compares it with itself. An empty table gives no rows.

    Ids are cut into ranges at quantiles.  Each range also gets the first id of the range after it, so every
    row meets its successor in one pass over one shuffle of the texts.  What is broadcast is one pair of numbers
    per range (rows / rows_per_bucket, held below 65536 ranges: beyond that ranges grow, the result does not change; rows of one id are one
    range at least, and stream through it).
    """
    # A null id is ordered first: the smallest long stands for it.
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), least).alias("at"), F.col(text_col).alias("text"))
    count = rows.count()
    if not count:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    ranges = max(1, min(65535, count // rows_per_bucket))
    ends = sorted(set(rows.select("at").approxQuantile("at", [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    spark = docs.sparkSession
    bounds = [int(x) for x in ends]
    # Bucket: how many bounds are at or below the id; a literal array, searched per row without a join.
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("at"))) if bounds and len(bounds) <= 32 else None
    if bucket is None:
        import numpy as np

        table = np.array(bounds, np.int64)

        @F.pandas_udf("int")
        def place(ids):
            import pandas as pd

            return pd.Series(np.searchsorted(table, ids.to_numpy(np.int64), "right").astype(np.int32))

        bucket = place("at") if bounds else F.lit(0)
    rows = rows.withColumn("own", bucket.cast("int"))
    firsts = [(r["own"], r["at"]) for r in rows.groupBy("own").agg(F.min("at").alias("at")).orderBy("own").collect()]  # one row per range
    halo = [(firsts[(k + 1) % len(firsts)][1], firsts[k][0]) for k in range(len(firsts))]
    halos = spark.createDataFrame(halo, "at long, before int")
    joined = rows.join(F.broadcast(halos), "at", "left")
    both = F.when(F.col("before").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("halo")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("halo")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("halo"))))
    spread = joined.select("doc_id", "at", "text", F.explode(both).alias("b")).select("b.bucket", "b.halo", "at", "doc_id", "text")
    return spread.repartition("bucket").sortWithinPartitions("bucket", "halo", "at", "text").select("bucket", "halo", "doc_id", "text").mapInArrow(_compare, SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
