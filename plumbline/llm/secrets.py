"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex runs. Wider candidates
(other long mixed strings) are added where the corpus shows them to be owner-specific:
their hash occurs in few repositories, with few owners and in few different texts, while
an example that many copy is left out. Only DataFrame functions are used: a text gives the lengths of its matches and of
the gaps between them, and running sums over those rows give the places, so work grows with the matches as a sort does.

Null and empty texts have no spans. Repeated rows each get their result.
Positions count code points; an end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import named, unused, written

ASSIGN = (
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: A run that may hold a credential of no base kind: letters of both cases and digits together.
OTHER = r"[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "other")
LEAST = (12, 18, 16, 20)
#: What is owner-specific: found in at most so many repositories, with so many owners, in so many different texts.
MOST_REPOS, MOST_OWNERS, MOST_TEXTS = 2, 2, 100
#: Characters of a piece of text.
PIECE = 4096


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Each match in order: the lengths of the gap before it, of itself and of what it holds, and that one's hash."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    inside = F.regexp_extract_all(text, F.lit(pattern), 2) if kind == "assign" else found

    def match(m: Column) -> Column:
        value = m["inside"]
        mixed = F.regexp_like(value, F.lit("[a-z]")) & F.regexp_like(value, F.lit("[A-Z]")) & F.regexp_like(value, F.lit("[0-9]")) if kind == "other" else F.lit(True)
        return F.struct(F.char_length(m["gaps"]).alias("gap"), F.char_length(m["found"]).alias("length"), F.char_length(value).alias("size"), F.xxhash64(value).alias("hash"), mixed.alias("fits"))

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gaps"), found.alias("found"), inside.alias("inside"))
    each = F.transform(F.filter(zipped, lambda m: m["found"].isNotNull()), match)
    return F.when(F.regexp_like(text, F.lit(pattern)), each)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, repo, owner, text_key) and their spans (row, text_key, repo, owner, start, rank, kind, end, hash).

    Texts are read once, into a table of lengths. Spans of no base kind are left out where they overlap one.
    """
    rows = named(docs, doc_id=id_col, text=text_col, repo=repo_col, owner=owner_col)
    text = F.coalesce("text", F.lit(""))
    patterns = zip(KINDS, (ASSIGN, ACCESS, HEX, OTHER), strict=True)
    rows = rows.select("doc_id", "repo", "owner", F.sha2(text, 256).alias("text_key"), *(_matches(text, pattern, kind).alias(kind) for kind, pattern in patterns))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    each = None
    for rank, (kind, least) in enumerate(zip(KINDS, LEAST, strict=True)):
        one = rows.select("row", "text_key", "repo", "owner", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"), F.lit(least).alias("least"))
        each = one if each is None else each.unionByName(one)
    place = F.sum(F.col("m.gap") + F.col("m.length")).over(Window.partitionBy("row", "rank").orderBy("i"))
    each = each.withColumn("end", place.cast("int")).where(F.col("m.fits") & (F.col("m.size") >= F.col("least")))
    each = each.select("row", "text_key", "repo", "owner", (F.col("end") - F.col("m.length")).alias("start"), "rank", "kind", "end", F.col("m.hash").alias("hash"))
    base = F.col("rank") < KINDS.index("other")
    # both look back, as a frame that ends with the partition is worked out anew for each row
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(base, F.col("end"))).over(before)
    ahead = F.min(F.when(base, F.col("start"))).over(after)
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    spans = each.withColumn("free", base | free).where("free").drop("free")
    return rows.drop(*KINDS), written(spans)


def ownership(spans: DataFrame) -> DataFrame:
    """For each candidate hash the different texts, repositories and owners that have it.

    Rows are first summed by hash, repository, owner and text, so a hash that a third of
    the corpus copies reaches the second shuffle as one row a text.
    """
    texts = spans.select("hash", "repo", "owner", "text_key").distinct().groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return texts.groupBy("hash").agg(F.sum("n").alias("copies"), F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def _judged(spans: DataFrame, most_repos: int, most_owners: int, most_texts: int) -> DataFrame:
    """The spans with live, whether each is owner-specific."""
    live = (F.col("repos") <= most_repos) & (F.col("owners") <= most_owners) & (F.col("copies") <= most_texts)
    return spans.join(ownership(spans), "hash").withColumn("live", live)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", most_repos: int = MOST_REPOS, most_owners: int = MOST_OWNERS, most_texts: int = MOST_TEXTS) -> DataFrame:
    """One row a document: counts and spans by kind, and how its candidates are owned.

    A candidate of no base kind becomes a span where its hash occurs in at most
    most_repos repositories, with at most most_owners owners and in at most most_texts different texts. n_live counts
    all spans that are owner-specific so, n_example those that are not. One base
    span may lie in another (a hex run in an assignment); each counts.
    """
    rows, spans = candidates(docs, id_col, text_col, repo_col, owner_col)
    judged = _judged(spans, most_repos, most_owners, most_texts).where((F.col("kind") != "other") | F.col("live"))
    span = F.struct("start", "rank", "kind", "end")
    sums = judged.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:3]),
        F.collect_list(F.when(F.col("kind") != "other", span)).alias("base"), F.collect_list(span).alias("all"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_example")]
    none = F.lit("")
    return rows.join(sums, "row", "left").select("doc_id", *numbers[:3], F.sha2(F.coalesce(_joined(F.col("base")), none), 256).alias("base_sha256"), F.coalesce(_joined(F.col("all")), none).alias("spans"), *numbers[3:])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", most_repos: int = MOST_REPOS, most_owners: int = MOST_OWNERS, most_texts: int = MOST_TEXTS, mark: str = "[SECRET]") -> DataFrame:
    """docs with the mark in place of each owner-specific span, all else kept.

    Only what occurs in more repositories, with more owners or in more texts is left in the text, as an example.
    A span that begins inside the one before is struck with it.
    """
    rows, spans = candidates(docs, id_col, text_col, repo_col, owner_col)
    id_, key, cuts, pieces = unused(docs, "id", "key", "cuts", "pieces")
    reach = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = _judged(spans, most_repos, most_owners, most_texts).where("live").withColumn("from", reach)
    cut = cut.groupBy("row").agg(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", "start"))).alias(cuts), F.max("end").alias("last"))
    # copies of a row have the same cuts, which one of them stands for
    live = rows.join(cut, "row").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.min_by(F.struct(F.array_sort(cuts).alias("all"), "last"), "row").alias(cuts))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.join(live, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.sha2(text, 256) == F.col(key)), "left")
    # a text with cuts goes in pieces, as places in a long text are found by counting from its start
    rows = rows.withColumn(pieces, F.when(F.col(cuts).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), 1)))

    def between(a: Column, b: Column) -> Column:
        first, end = (a / PIECE).cast("int"), (b / PIECE).cast("int")
        one, two = (F.coalesce(F.get(pieces, i), F.lit("")) for i in (first, end))
        inside = F.array_join(F.slice(pieces, first + 2, F.greatest(end - first - 1, F.lit(0))), "")
        return F.when(first == end, F.substring(one, a - first * PIECE + 1, b - a)).otherwise(F.concat(F.substring(one, a - first * PIECE + 1, F.lit(PIECE)), inside, F.substring(two, F.lit(1), b - end * PIECE)))

    parts = F.transform(F.col(cuts)["all"], lambda c: F.concat(between(c["from"], c["start"]), F.lit(mark)))
    done = F.concat(F.array_join(parts, ""), between(F.col(cuts)["last"], F.char_length(text)))
    return rows.withColumn(text_col, F.when(F.col(cuts).isNull(), F.col(f"`{text_col}`")).otherwise(done)).drop(id_, key, cuts, pieces)
