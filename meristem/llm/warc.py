"""Merkle fixity audit of WARC records.

A store is a table of files: ``file``, ``slot`` (a record's place by id), ``page_id`` and ``record``, the record's WARC bytes.
``lay_out`` writes pages as such records; a file holds ``fanout ** 2`` consecutive ids. ``leaves`` reads the stored bytes: a record's
offset range follows from the lengths before it in its file, its header is parsed, and its leaf is the SHA-256 of
slot, offset, length and the SHA-256 of its bytes. A node is the SHA-256 of the offset range that it covers and of its
children's positions and hashes, in order, up to a root for each file.

Each replica's bytes are read once: leaves and inner levels are written to the shared folder. Two replicas are compared at the
roots; only the files whose roots differ have their inner nodes compared, and only below differing nodes are records
compared. A lost record moves the records behind it, whose leaves then differ by offset alone: they are counted as
moved, not as bad.

Defined cases: rows without an id are no records; null urls and bodies are empty; rows that repeat an id share a leaf, whose
hash covers all of them in hash order; a record on one side only is ``lost`` or ``extra``; one whose Content-Length isn't
its body's length is ``torn``, any other with different bytes ``changed``; other columns are ignored; empty tables give no files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import staged

FANOUT = 16


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A response record's text."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def lay_out(pages: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Pages (page_id, url, html) as stored records: file, slot, page_id, record (binary)."""
    size = fanout * fanout
    known = pages.where("page_id IS NOT NULL").withColumn("page_id", F.col("page_id").cast("long"))
    text = record(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    return known.select(F.floor(F.col("page_id") / size).alias("file"), F.pmod("page_id", F.lit(size)).alias("slot"), "page_id", F.encode(text, "UTF-8").alias("record"))


def parsed(bytes_: Column) -> Column:
    """What a stored record's header says: version, record id, content length; and whether its body has that length."""
    text = F.decode(bytes_, "UTF-8")
    head = F.substring_index(text, "\r\n\r\n", 1)
    said = F.regexp_extract(head, r"(?m)^Content-Length: ([0-9]{1,18})\r?$", 1).cast("long")
    body = F.octet_length(bytes_) - F.octet_length(F.encode(head, "UTF-8")) - 8
    whole = head.startswith("WARC/1.") & (said == body) & text.endswith("\r\n\r\n")
    return F.struct(F.regexp_extract(head, r"^WARC/([0-9.]+)", 1).alias("version"), F.regexp_extract(head, r"(?m)^WARC-Record-ID: <([^>\r\n]*)>", 1).alias("id"), said.alias("said"), F.coalesce(whole, F.lit(False)).alias("whole"))


def leaves(store: DataFrame) -> DataFrame:
    """A row per stored record id: file, slot, bytes_hash, offset, length, whole, hash."""
    each = store.select("file", "slot", F.sha2("record", 256).alias("h"), F.octet_length("record").cast("long").alias("n"), parsed(F.col("record"))["whole"].alias("whole"))
    one = each.groupBy("file", "slot").agg(F.array_sort(F.collect_list("h")).alias("hs"), F.sum("n").alias("length"), F.min("whole").alias("whole"))
    one = one.withColumn("bytes_hash", F.when(F.size("hs") == 1, F.col("hs")[0]).otherwise(F.sha2(F.array_join("hs", ","), 256)))
    before = W.partitionBy("file").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    spelled = F.concat_ws(":", *[F.col(c).cast("string") for c in ("slot", "offset", "length")], "bytes_hash")
    return one.select("file", "slot", "bytes_hash", "offset", "length", "whole", F.sha2(spelled, 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: file, slot, offset and length of the range covered, hash over that range and the children."""
    end = F.max(F.col("offset") + F.col("length"))
    child = F.array_sort(F.collect_list(F.struct("slot", "hash")))
    joined = F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["slot"].cast("string"), c["hash"])), ",")
    above = nodes.groupBy("file", F.floor(F.col("slot") / fanout).alias("slot")).agg(F.min("offset").alias("offset"), (end - F.min("offset")).alias("length"), joined.alias("joined"), F.count("*").alias("n"))
    spelled = F.concat(F.col("offset").cast("string"), F.lit("+"), F.col("length").cast("string"), F.lit("|"), F.col("joined"))
    return above.select("file", "slot", "offset", "length", F.sha2(spelled, 256).alias("hash"), "n")


def tree(store: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, inner nodes and roots of a store, written to the shared folder; the bytes are read once."""
    level0 = staged(leaves(store), "warc-leaves")
    level1 = staged(parents(level0, fanout), "warc-nodes")
    return level0, level1, staged(parents(level1.drop("n"), fanout).drop("n"), "warc-roots")


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Audit of two stores. A row per file: file, n_records, root, replica_root, matches, n_nodes (inner nodes that differ), n_moved,
    n_bad, bad (state:offset+length of the primary, or of the replica for extra records, comma-joined by offset)."""
    (a0, a1, a2), (b0, b1, b2) = tree(primary, fanout), tree(replica, fanout)
    count = a1.groupBy("file").agg(F.sum("n").alias("n_records"))
    other = lambda nodes: nodes.select("file", "slot", F.col("hash").alias("other"))
    roots = a2.select("file", "slot", "hash").join(other(b2).hint("merge"), ["file", "slot"], "full").select("file", F.col("hash").alias("root"), F.col("other").alias("replica_root"))
    roots = staged(roots.withColumn("matches", F.col("root").eqNullSafe(F.col("replica_root"))), "warc-compared")
    apart = roots.where("NOT matches").select("file").hint("merge")
    level1 = [x.join(apart, "file", "left_semi") for x in (a1.select("file", "slot", "hash"), other(b1))]
    nodes = staged(level1[0].join(level1[1].hint("merge"), ["file", "slot"], "full").where("NOT (hash <=> other)").select("file", F.col("slot").alias("node")), "warc-differing")
    below = lambda level: level.withColumn("node", F.floor(F.col("slot") / fanout)).join(nodes.hint("merge"), ["file", "node"], "left_semi").drop("node")
    right = below(b0).select("file", "slot", *[F.col(c).alias(f"{c}_2") for c in ("bytes_hash", "offset", "length", "whole", "hash")])
    met = below(a0).join(right.hint("merge"), ["file", "slot"], "full").where("NOT (hash <=> hash_2)")
    state = F.when(F.col("hash_2").isNull(), "lost").when(F.col("hash").isNull(), "extra").when(F.col("bytes_hash") == F.col("bytes_hash_2"), "moved").when(F.col("whole_2"), "changed").otherwise("torn")
    each = met.select("file", F.coalesce("offset", "offset_2").alias("at"), F.coalesce("length", "length_2").alias("n"), state.alias("state"))
    bad = F.col("state") != "moved"
    entries = F.array_sort(F.collect_list(F.when(bad, F.struct("at", "n", "state"))))
    spelled = F.transform(entries, lambda x: F.concat(x["state"], F.lit(":"), x["at"].cast("string"), F.lit("+"), x["n"].cast("string")))
    found = each.groupBy("file").agg(F.count_if(~bad).alias("n_moved"), F.count_if(bad).alias("n_bad"), F.array_join(spelled, ",").alias("bad"))
    inner = nodes.groupBy("file").agg(F.count("*").alias("n_nodes"))
    out = roots
    for more in (count, inner, found):
        out = out.join(more.hint("merge"), "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("file", zero("n_records"), "root", "replica_root", "matches", zero("n_nodes"), zero("n_moved"), zero("n_bad"), F.coalesce("bad", F.lit("")).alias("bad"))
