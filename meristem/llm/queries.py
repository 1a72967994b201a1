"""Thin queries over the training-data operators, as the driver's contract fixes their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matroska, pii, warc
from .decontaminate import decontaminate
from .language_id import fold, predict, train
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .quality import score as score_quality
from .quality import train as train_quality
from .token_counts import edited_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.spelled("base"), 256).alias("base_sha256"),
        pii.spelled("spans").alias("spans"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The contract's word class of op2 and its complement.
_WORD, _GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP2_SQL = f"""
WITH asked AS (
    SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS key
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM asked WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
), parts AS (
    SELECT row, doc_id, regexp_extract_all(t, '{_WORD}') AS w, regexp_extract_all(t, '{_GAP}') AS g, regexp_matches(t, '^{_GAP}') AS led FROM docs
), words AS (
    SELECT row, pos, len, coalesce(sum(len + gap) OVER before, 0) + CASE WHEN led THEN gap ELSE 0 END AS start
    FROM (SELECT row, led, unnest(range(1, len(w) + 1)) AS pos, length(unnest(w)) AS len, coalesce(length(unnest(g[1 : len(w)])), 0) AS gap FROM parts WHERE len(w) > 0)
    WINDOW before AS (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
    SELECT DISTINCT d.row, d.pos, d.n, v.item_id
    FROM (SELECT row, s.n, pos, array_to_string(w[pos : pos + s.n - 1], ' ') AS key
          FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS pos FROM parts), (SELECT DISTINCT n FROM windows) s WHERE pos + s.n - 1 <= len(w)) d
    JOIN windows v ON v.n = d.n AND v.key = d.key
), hit AS (
    SELECT DISTINCT row, unnest(range(pos, pos + n)) AS pos FROM found
), runs AS (
    SELECT row, min(start) AS a, max(start + len) AS b
    FROM (SELECT row, pos, start, len, pos - row_number() OVER (PARTITION BY row ORDER BY pos) AS run FROM hit JOIN words USING (row, pos)) GROUP BY row, run
), hits AS (
    SELECT row, count(*) AS n_hit FROM hit GROUP BY row
), spelled AS (
    SELECT row, string_agg(a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a) AS spans FROM runs GROUP BY row
), items AS (
    SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
FROM parts LEFT JOIN hits USING (row) LEFT JOIN spelled USING (row) LEFT JOIN items USING (row)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after four edits of every document: a replacement, an insertion and a deletion at places
    that its id gives, and an appended line."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    place = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    edit = lambda start, length, insert: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(insert).alias("insert"))
    edits = F.array(edit(place % (n + 1), 9, "revised"), edit((place * 31) % (n + 1), 0, " (see 42) "), edit(F.floor(n / 2), 12, ""), edit(n + 8, 0, "\nEnd."))
    return edited_counts(documents, edits, ["doc_id"]).drop("text_after")


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of the WARC store of ``pages`` whose bytes have faults planted by id: a changed character, a lost
    tail, a lost record."""
    store = warc.lay_out(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.decode("record", "UTF-8")
    half = F.floor(F.length(text) / 2).cast("int")
    flipped = F.concat(F.left(text, half), F.lit("~"), F.substring(text, half + 2, F.length(text)))
    damaged = F.when(F.col("page_id") % 997 == 5, flipped).when(F.col("page_id") % 1009 == 7, F.left(text, F.greatest(F.length(text) - 10, F.lit(0)))).otherwise(text)
    replica = store.where("page_id % 1511 <> 3").withColumn("record", F.encode(damaged, "UTF-8"))
    return warc.audit(store, replica)


_OP5_SQL = f"""
WITH stored AS (
    SELECT page_id, page_id // {warc.FANOUT**2} AS file, page_id % {warc.FANOUT**2} AS slot,
           'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
           || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
    FROM pages WHERE page_id IS NOT NULL
), rec AS (
    SELECT 0 AS side, file, slot, r FROM stored
    UNION ALL
    SELECT 1, file, slot,
           CASE WHEN page_id % 997 = 5 THEN left(r, length(r) // 2) || '~' || substring(r, length(r) // 2 + 2)
                WHEN page_id % 1009 = 7 THEN left(r, greatest(length(r) - 10, 0)) ELSE r END
    FROM stored WHERE page_id % 1511 <> 3
), cut AS (
    SELECT *, split_part(r, chr(13) || chr(10) || chr(13) || chr(10), 1) AS head FROM rec
), l0 AS (
    SELECT side, file, slot, sha256(r) AS bytes_hash, strlen(r) AS n,
           coalesce(sum(strlen(r)) OVER (PARTITION BY side, file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
           coalesce(head LIKE 'WARC/1.%' AND TRY_CAST(regexp_extract(head, 'Content-Length: ([0-9]+)', 1) AS BIGINT) = strlen(r) - strlen(head) - 8
                    AND ends_with(r, chr(13) || chr(10) || chr(13) || chr(10)), false) AS whole
    FROM cut
), leaf AS (
    SELECT *, sha256(slot || ':' || off || ':' || n || ':' || bytes_hash) AS hash FROM l0
), l1 AS (
    SELECT side, file, slot // {warc.FANOUT} AS node, min(off) AS off, max(off + n) - min(off) AS n,
           sha256(min(off) || '+' || (max(off + n) - min(off)) || '|' || string_agg(slot || ':' || hash, ',' ORDER BY slot)) AS hash
    FROM leaf GROUP BY ALL
), l2 AS (
    SELECT side, file, sha256(min(off) || '+' || (max(off + n) - min(off)) || '|' || string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM l1 GROUP BY ALL
), roots AS (
    SELECT file, max(hash) FILTER (WHERE side = 0) AS root, max(hash) FILTER (WHERE side = 1) AS replica_root FROM l2 GROUP BY file
), nodes AS (
    SELECT file, node FROM l1 GROUP BY file, node HAVING max(hash) FILTER (WHERE side = 0) IS DISTINCT FROM max(hash) FILTER (WHERE side = 1)
), met AS (
    SELECT file, slot, coalesce(max(off) FILTER (WHERE side = 0), max(off)) AS off, coalesce(max(n) FILTER (WHERE side = 0), max(n)) AS n,
           CASE WHEN count(*) FILTER (WHERE side = 1) = 0 THEN 'lost' WHEN count(*) FILTER (WHERE side = 0) = 0 THEN 'extra'
                WHEN min(bytes_hash) = max(bytes_hash) THEN 'moved' WHEN bool_and(whole) FILTER (WHERE side = 1) THEN 'changed' ELSE 'torn' END AS state
    FROM leaf GROUP BY file, slot HAVING max(hash) FILTER (WHERE side = 0) IS DISTINCT FROM max(hash) FILTER (WHERE side = 1)
)
SELECT r.file, (SELECT count(*) FROM leaf WHERE leaf.side = 0 AND leaf.file = r.file)::BIGINT AS n_records, r.root, r.replica_root,
       r.root IS NOT DISTINCT FROM r.replica_root AS matches,
       (SELECT count(*) FROM nodes n WHERE n.file = r.file)::BIGINT AS n_nodes,
       (SELECT count(*) FROM met m WHERE m.file = r.file AND state = 'moved')::BIGINT AS n_moved,
       (SELECT count(*) FROM met m WHERE m.file = r.file AND state <> 'moved')::BIGINT AS n_bad,
       coalesce((SELECT string_agg(state || ':' || off || '+' || n, ',' ORDER BY off) FROM met m WHERE m.file = r.file AND state <> 'moved'), '') AS bad
FROM roots r
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


_OP4_SQL = """
WITH lines AS (
    SELECT d.doc_id, u.line, u.pos,
           translate(regexp_replace(regexp_replace(u.line, '^[ \\t-\\r]+', ''), '[ \\t-\\r]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
         LATERAL (SELECT unnest(d.parts) AS line, unnest(range(1, len(d.parts) + 1)) AS pos) u
), owners AS (
    SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
    SELECT l.doc_id, l.line, l.pos, o.owner IS NOT NULL AND o.owner <> l.doc_id AS dropped
    FROM lines l LEFT JOIN owners o ON l.key = o.key AND length(l.key) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::BIGINT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


_OP6_SQL = f"""
WITH RECURSIVE parts AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM parts WHERE len(w) > 0)
), sets AS (
    SELECT doc_id, count(*) AS n, sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS own FROM shingles GROUP BY doc_id
), named AS (
    SELECT doc_id, n, min(doc_id) OVER (PARTITION BY own) AS rep FROM sets
), heads AS (
    SELECT s.doc_id, n, shingle FROM shingles s JOIN named USING (doc_id) WHERE doc_id = rep
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)
), reached AS (
    SELECT DISTINCT rep AS a, rep AS b FROM named UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), lowest AS (
    SELECT a AS rep, min(b) AS c FROM reached GROUP BY a
)
SELECT p.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, p.doc_id) AS component_id, coalesce(c, p.doc_id) = p.doc_id AS kept
FROM parts p LEFT JOIN named USING (doc_id) LEFT JOIN lowest USING (rep)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = train(documents.where(fold("doc_id", 3) != 1))
    scored = predict(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = train_quality(documents.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    scored = score_quality(documents, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = matroska.store(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    # The contract's tail is that of the payload as read back, so with its padding.
    return matroska.features(stored, ["doc_id"]).withColumn("tail_crc32", F.col("payload_tail_crc32")).drop("payload_tail_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_token_counts, op4_line_dedup, op5_warc_audit, op6_near_dedup, op7_packing, op8_language_id, op9_quality, op10_matroska)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2_SQL, "op4_line_dedup": _OP4_SQL, "op5_warc_audit": _OP5_SQL, "op6_near_dedup": _OP6_SQL}
