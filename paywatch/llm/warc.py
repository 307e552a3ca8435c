"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is one row of text; the writer's line separator is the blank lines between records. Of the records
with equal payloads of at least ``least_revisit`` bytes the one with the smallest page id is a response, the others are
revisits that name it and carry no payload.

Reading. Spark's reader cuts the archives at every magic line, wherever it splits the files; each piece is a candidate
record. The pieces of a split come in order, so running sums over a split, and over the splits before it, give a piece's
offset in the file. A candidate whose header parses has a successor: its offset plus header, payload and blank lines.
A split follows its own candidates to where their chains leave it; across splits the chain from the start of the file is
followed by pointer jumping, which doubles its reach each round. What the chain reaches is a record: a magic line inside
a payload is passed over, whatever follows it. Payloads that contain magic lines are put together from their pieces.

Defined results: a null payload is empty; a null id or URL is an empty field, and a line break in a URL is written as a
space; equal rows with the smallest id are all responses; an empty table gives an archive without records; a file that
does not begin with a record has none. A header field must not end with the magic line. Other columns are not written.
"""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from paywatch.session import materialize, new_path

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*)$")
#: Pieces of one long payload are found by cells of so many bytes.
CELL = 1 << 22
HEADER = {
    "kind": "WARC-Type", "name": "WARC-Record-ID", "refers": "WARC-Refers-To", "url": "WARC-Target-URI",
    "stated_digest": "WARC-Payload-Digest", "stated_bytes": "X-Payload-Length",
}
PIECE = pa.schema([
    ("path", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("step", pa.int64()),
    ("head", pa.int64()), ("body", pa.int64()), ("fits", pa.bool_()), ("digest", pa.string()), *[(n, pa.string()) for n in HEADER],
])
PIECE_DDL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'boolean' if f.type == pa.bool_() else 'string'}" for f in PIECE)


def records(pages, key="page_id", url="url", payload="html", least_revisit=LEAST_REVISIT):
    """One row ``value`` for each record, without the blank lines that end it."""
    given = pages.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body")
    ).withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha2("body", 256))
    equal = (
        given.where(F.col("bytes") >= least_revisit).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select(F.col("digest").alias("d"), "first")
    )
    marked = given.join(equal, F.col("digest") == F.col("d"), "left")
    lead = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    body = F.when(lead, F.col("body")).otherwise(F.lit(""))
    refers = F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    return marked.select(F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(lead, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("\r\nWARC-Target-URI: <"), F.translate("url", "\r\n", "  "), F.lit(">\r\n"), F.when(lead, F.lit("")).otherwise(refers),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK), body,
    ).alias("value"))


def write(pages, path=None, **options):
    """Writes the archives and returns their folder."""
    path = path or new_path(pages.sparkSession, "warc")
    records(pages, **options).write.option("lineSep", BLANK).option("compression", "none").text(path)
    return path


def header(piece):
    """Length of the header at the start of a piece, the payload's length and the fields, or None."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        found = FIELD.match(line)
        if not found:
            return None
        fields[found[1].decode()] = found[2]
    length = fields.get("Content-Length", b"")
    return (end + 4, int(length), fields) if length.isdigit() else None


def _candidates(batches):
    """Pieces of each split with their offset in the split and what their headers say."""
    at, place = None, 0
    for batch in batches:
        out = {name: [] for name in PIECE.names}
        pieces = batch.column("value").cast(pa.binary())
        for path, split, piece in zip(batch.column("path").to_pylist(), batch.column("split").to_pylist(), pieces, strict=True):
            piece = piece.as_py() or b""
            if at != (path, split):
                at, place = (path, split), 0
            # What stands before the first magic line of a file is no candidate.
            parsed = None if split == 0 and place == 0 else header(piece)
            head, body, fields = parsed or (None, None, {})
            fits = parsed is not None and len(piece) == head + body + len(BLANK)
            row = {
                "path": path, "split": split, "at": place, "size": len(piece) + len(MAGIC), "head": head, "body": body, "fits": fits,
                "step": place + head + body + len(BLANK) + len(MAGIC) if parsed else None,
                "digest": hashlib.sha256(piece[head:head + body]).hexdigest() if fits else None,
                **{n: fields[f].decode("utf-8", "replace") if f in fields else None for n, f in HEADER.items()},
            }
            for name in out:
                out[name].append(row[name])
            place += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_pydict(out, PIECE)


def _raw(batches):
    """Pieces with their offset in the split."""
    at, place = None, 0
    for batch in batches:
        places = []
        pieces = batch.column("value").cast(pa.binary())
        for path, split, size in zip(
            batch.column("path").to_pylist(), batch.column("split").to_pylist(), pa.compute.binary_length(pieces).to_pylist(), strict=True
        ):
            if at != (path, split):
                at, place = (path, split), 0
            places.append(place)
            place += (size or 0) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("split"), pa.array(places, pa.int64()), pieces], ["path", "split", "at", "piece"])


def _lines(spark, path):
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split")
    )


def _bases(pieces):
    """Offset in the file at which the pieces of each split begin and end."""
    sizes = pieces.groupBy("path", "split").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")


def _exits(key, table):
    """Where the chain of each candidate of a split leaves the split."""
    table = table.sort_values("at", ignore_index=True)
    at, step = table["at"].to_numpy(np.int64), table["step"].to_numpy(np.int64)
    index = np.minimum(np.searchsorted(at, step), len(at) - 1)
    target = np.where(at[index] == step, index, np.arange(len(at)))
    while True:
        further = target[target]
        if (further == target).all():
            return pd.DataFrame({"path": table["path"], "split": table["split"], "at": at, "out": step[target]})
        target = further


def _follow(key, entries, table):
    """The candidates of a split that the chain from its entry passes."""
    table = table.sort_values("at", ignore_index=True)
    at, step = table["at"].to_numpy(np.int64), table["step"].to_numpy(np.int64)
    kept = np.zeros(len(at), bool)
    for start in entries["at"].to_numpy(np.int64):
        k = int(np.searchsorted(at, start))
        while k < len(at) and at[k] == start and not kept[k]:
            kept[k] = True
            start = step[k]
            k = int(np.searchsorted(at, start))
    return table[kept][["path", "split", "at"]]


def _reached(jumps):
    """(path, at) of the entries that the chain from a file's first record comes to, and where it ends."""
    reached = materialize(jumps.where(F.col("at") == len(MAGIC)).select("path", "at"), "warc-reached")
    count = reached.count()
    while True:
        over = reached.join(jumps, ["path", "at"]).select("path", F.col("out").alias("at"))
        now = materialize(reached.union(over).distinct(), "warc-reached")
        more = now.count()
        if more == count:
            return now
        reached, count = now, more
        onward = jumps.select(F.col("path").alias("p"), F.col("at").alias("mid"), F.col("out").alias("far"))
        far = jumps.join(onward, (F.col("path") == F.col("p")) & (F.col("out") == F.col("mid")))
        jumps = materialize(far.select("path", "at", F.col("far").alias("out")), "warc-jumps")


def _whole(spark, path, long_records):
    """SHA-256 of payloads that contain magic lines: (path, at, digest)."""
    raw = _lines(spark, path).mapInArrow(_raw, "path string, split long, at long, piece binary")
    sizes = raw.select("path", "split", (F.octet_length("piece").cast("long") + len(MAGIC)).alias("size"))
    raw = raw.join(_bases(sizes), ["path", "split"]).select("path", (F.col("base") + F.col("at")).alias("place"), "piece")
    wanted = long_records.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("at") / CELL), F.floor((F.col("at") + F.col("head") + F.col("body")) / CELL)))
    )
    inside = (F.col("place") >= F.col("at")) & (F.col("place") <= F.col("at") + F.col("head") + F.col("body"))
    found = raw.withColumn("cell", F.floor(F.col("place") / CELL)).join(wanted, ["path", "cell"]).where(inside)
    parts = found.groupBy("path", "at", "head", "body").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    text = F.concat_ws(MAGIC, F.transform("parts", lambda p: p["piece"].cast("string")))
    body = F.substring(text.cast("binary"), F.col("head").cast("int") + 1, F.col("body").cast("int"))
    return parts.select("path", "at", F.sha2(body, 256).alias("whole_digest"))


def read(spark, path):
    """Records of the archives: ``path``, ``at`` (offset behind the magic line), the header's fields, ``body`` (bytes of
    the payload in the archive) and its SHA-256 ``digest``."""
    pieces = materialize(_lines(spark, path).mapInArrow(_candidates, PIECE_DDL), "warc-pieces")
    bases = materialize(_bases(pieces), "warc-splits")
    placed = pieces.where("step is not null").join(bases, ["path", "split"])
    links = placed.select("path", "split", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("step")).alias("step"))
    exits = materialize(links.groupBy("path", "split").applyInPandas(_exits, "path string, split long, at long, out long"), "warc-exits")
    # Only a file's first record and where some chain leaves its split can be entries.
    doors = exits.select("path", F.col("out").alias("at")).union(exits.where(F.col("at") == len(MAGIC)).select("path", "at")).distinct()
    jumps = materialize(exits.join(doors, ["path", "at"], "left_semi").select("path", "at", "out"), "warc-jumps")
    entries = _reached(jumps).join(exits, ["path", "at"]).select("path", "split", "at")
    chained = entries.groupBy("path", "split").cogroup(links.groupBy("path", "split")).applyInPandas(_follow, "path string, split long, at long")
    chained = chained.withColumnRenamed("at", "reached")
    found = placed.withColumn("place", F.col("base") + F.col("at")).join(
        chained, [placed["path"] == chained["path"], placed["split"] == chained["split"], F.col("place") == F.col("reached")]
    ).select(placed["path"], F.col("place").alias("at"), "head", "body", "fits", "digest", *HEADER)
    found = materialize(found, "warc-records")
    cut = found.where("not fits").select("path", "at", "head", "body")
    if not cut.take(1):
        return found.drop("head", "fits")
    found = found.join(_whole(spark, path, cut), ["path", "at"], "left")
    return found.withColumn("digest", F.coalesce("digest", "whole_digest")).drop("head", "fits", "whole_digest")


def number(column):
    """The page id inside a record's name."""
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
