"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, broadcast_if_small, hot_split, materialise, table

WINDOW, GRAM = 13, 4
#: Bounds on the bytes of a broadcast row: a prefix (token, offset, length, window), and a window with its words and items.
PREFIX_BYTES, WINDOW_BYTES = 64, 2048
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _grams(w: Column, k: int) -> Column:
    """Hashes of the runs of k words, by position from 0."""
    n = F.size(w) - k
    at = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)]))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (wid, w, len, items) of items (item_id, text): runs of `window` words, or all words of a shorter item that has any."""
    w = items.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    n = F.greatest(F.size("all") - window, F.lit(0))
    each = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("all", i + 1, window))).alias("w"))
    return each.groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(F.xxhash64("w").alias("wid"), "w", F.size("w").alias("len"), "items")


def _tokens(df: DataFrame, keep: list[str], k: int) -> DataFrame:
    return df.select(*keep, F.posexplode(_grams(F.col("w"), k)).alias("at", "gram"))


def _prefixes(win: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """The rarest token of each window (gram, offset, len, wid, df), rarity being counted over all texts; windows with an absent token are out."""
    own = materialise(_tokens(win, ["wid", "len"], k), "tokens")
    known = own.select("gram").distinct()
    counts = materialise(_tokens(text, [], k).join(broadcast_if_small(known, own.count(), 24), "gram").groupBy("gram").agg(F.count("*").alias("df")), "rarity")
    first = own.join(counts, "gram", "left").groupBy("wid", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "at", "gram")).alias("first")).where("first.df > 0")
    return materialise(first.select(F.col("first.gram").alias("gram"), F.col("first.at").alias("offset"), "len", "wid", F.col("first.df").alias("df")), "prefix")


def _candidates(text: DataFrame, prefix: DataFrame, k: int) -> DataFrame:
    """Places (doc_id, text_key, start, wid, slice) where the positional bound leaves room for a window and the words there have its hash.

    While the counted prefixes stay under the broadcast bound, one pass over the words finds them. Otherwise narrow rows of positions are shuffled by token, those of hot
    tokens against a broadcast of their prefixes, and what the positions leave meets the words again by document.
    """
    row = ["doc_id", "text_key"]
    start = (F.col("at") - F.col("offset")).alias("start")
    room = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("len") <= F.col("n_words"))
    piece = F.slice("w", F.greatest("start", F.lit(0)) + 1, F.col("len"))
    n = prefix.count()
    narrow = prefix.select("gram", "offset", "len", "wid")
    if n * PREFIX_BYTES <= BROADCAST_BYTES:
        met = _tokens(text, [*row, "n_words", "w"], k).join(F.broadcast(narrow), "gram").where(room).select(*row, "w", start, "len", "wid")
    else:
        hot, rest = hot_split(prefix, text.agg(F.sum("n_words")).first()[0] or 0, "df")
        hot = hot.select(*narrow.columns)
        places = _tokens(text, [*row, "n_words"], k)
        cold = places.join(broadcast_if_small(hot.select("gram").distinct(), hot.count(), 24), "gram", "left_anti")
        met = places.join(broadcast_if_small(hot, hot.count(), PREFIX_BYTES), "gram").unionByName(cold.join(rest.select(*narrow.columns), "gram")).where(room).select(*row, start, "len", "wid").distinct()
        words = text.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "w").dropDuplicates(["_id", "_key"])
        met = materialise(met, "places").join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).drop("_id", "_key")
    return met.where(F.xxhash64(piece) == F.col("wid")).select(*row, "start", "wid", piece.alias("slice"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Documents (doc_id, text) against benchmark items (item_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, a row for each row of docs.

    A word inside any occurrence of a window is hit; share * n_hit >= n_words > 0 with n_hit > 0 is contamination. Null and wordless texts of either
    side have no words and no windows. Rows that repeat a doc_id are judged by their own text; a null doc_id is a value like others; a null item_id
    isn't listed. Windows that several items share are matched once. Ids may have any type; texts are read whole, however long. Extra columns play no part.

    Texts are cut into words once, and the words written to the shared folder for the passes.
    The tokens of the set join are runs of GRAM words (or of the whole window where it is shorter). A window can only occur where all its tokens do,
    so its prefix is one token. Pass 1 counts, over all documents, those tokens that windows have; a window with an absent token is out.
    The rarest of each remaining window joins in pass 2, where the position in the text, less the token's place in the window, must leave room
    for the whole window (see _candidates); what has the window's hash there is compared with its words.
    """
    win = materialise(windows(items.select("item_id", "text"), window), "windows")
    sizes = sorted(r[0] for r in win.select(F.least("len", F.lit(GRAM))).distinct().limit(GRAM).collect())
    text = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    text = materialise(text.withColumn("n_words", F.size("w").cast("long")), "words")
    n = win.count()
    parts = []
    for k in sizes or [GRAM]:
        mine = win.where(F.least("len", F.lit(GRAM)) == k)
        near = _candidates(text, _prefixes(mine.select("wid", "len", "w"), text, k), k)
        known = mine.select(F.col("wid").alias("_wid"), F.col("w").alias("_w"), "len", "items")
        parts.append(near.join(broadcast_if_small(known, n, WINDOW_BYTES), (F.col("wid") == F.col("_wid")) & (F.col("slice") == F.col("_w"))).select("doc_id", "text_key", F.col("start").alias("start"), "len", "items"))
    found = reduce(DataFrame.unionByName, parts)
    spans = F.array_sort(F.collect_set(F.struct("start", "len")))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["start"] + x["len"]).alias("end")))["n"]
    names = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string")))
    hit = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(covered.cast("long").alias("n_hit"), names.alias("item_names"))
    out = text.select("doc_id", "text_key", "n_words").join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    names = F.coalesce("item_names", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_key",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contamination() doesn't mark."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key")), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def contamination_sql(docs: str) -> str:
    """Common table expressions for DuckDB from a relation docs(doc_id, text) to judged(doc_id, ...)."""
    split = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
item_words as (select item_id, {split} as w from benchmark),
item_windows as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as s, least(len(w), 13) as n from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item_words where len(w) > 0)),
doc_words as (select doc_id, {split} as w from {docs}),
doc_windows as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, (select distinct n from item_windows))),
occurs as (select distinct doc_id, i, d.n, item_id from doc_windows d join item_windows m on d.s = m.s and d.n = m.n),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occurs) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct doc_id, item_id from occurs) group by doc_id),
judged as (select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
   coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from doc_words left join hits using (doc_id) left join hit_items using (doc_id))"""


SQL = {"op9_decontamination": f"with {contamination_sql('documents')} select * from judged"}
