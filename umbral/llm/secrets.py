"""Secret scanning with corpus-wide ownership frequency, in DataFrame operations only.

Patterns of two kinds find candidates, leftmost and non-overlapping for each kind. Base kinds (assign,
access, hex) are always reported. Method kinds (vendor, key, random) cast a wider net and are
reported where the corpus says that they are live-looking: the candidate's value is hashed, counted over
distinct repositories and distinct owners, and a value that many owners or many repositories carry is a
copied example, while one of few that also looks random is taken for a credential.

Positions are code points, end exclusive. Null and empty texts have no spans. Rows that share id
and text get equal results. A null repository or owner counts as one of its own. Frequency
counts are sums over partial aggregates, so neither a hot source nor a value that is everywhere meets in one
task; only the spans of one document are gathered together.
"""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, work_folder

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: kind -> (pattern, group of the value). Order is the order of kinds at one start.
BASE = {
    "assign": (ASSIGN, 2),
    "access": (r"AKIA[A-Z0-9]{14,}", 0),
    "hex": (r"[0-9a-f]{16,}", 0),
}
METHOD = {
    "vendor": (r"(?:gh[pousr]_|glpat-|sk_live_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", 0),
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n ]+-----END [A-Z ]*PRIVATE KEY-----", 0),
    "random": (r"[A-Za-z0-9+/_-]{24,}", 0),
}
KINDS = {**BASE, **METHOD}
#: Least length of a value of the kind assign.
ASSIGN_VALUE = 12
#: Values of more owners, or of more repositories, than this are copied examples.
MAX_OWNERS, MAX_REPOS = 2, 20
#: Distinct characters that a live-looking value has, besides a digit and a letter.
DISTINCT_CHARS = 8
MARK = "[SECRET]"


def matches(text: Column, kind: str) -> Column:
    """Array of (gap, whole, value): what lies between matches, in characters, and what was matched."""
    pattern, group = KINDS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), value.alias("v")) if group else F.transform(whole, lambda w: F.struct(w.alias("w"), w.alias("v"))), lambda g, m: F.struct(g.alias("gap"), m["w"].alias("whole"), m["v"].alias("value")))
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<gap:int,whole:string,value:string>>"))


def live_looking(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per row of docs, without its text: id, tag (of the text), repo, owner and the matches of all kinds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    tag = F.xxhash64("text", F.length("text"))
    return durable(named.select("id", tag.alias("tag"), "repo", "owner", *[matches(F.col("text"), k).alias(k) for k in KINDS]))


def spans(found: DataFrame) -> DataFrame:
    """id, tag, owner, repo, kind, start, end, value_start, value_hash, looks_live: one row per span of each distinct (id, tag, repo, owner)."""
    # Repeated rows have equal spans; one of each is enough, so that a row that is everywhere meets in no window.
    found = found.where(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])).dropDuplicates(["id", "tag", "repo", "owner"])
    parts = [
        found.where(F.size(k) > 0).select("id", "tag", "repo", "owner", F.lit(i).alias("order"), F.lit(k).alias("kind"), F.posexplode(k).alias("i", "m"))
        for i, k in enumerate(KINDS)
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("id", "tag", "repo", "owner", "order", "kind", "i", F.col("m.gap").alias("gap"), F.length("m.whole").alias("size"), F.col("m.value").alias("value"))
    before = W.partitionBy("id", "tag", "repo", "owner", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("long"))
    placed = placed.where((F.col("kind") != "assign") | (F.length("value") >= ASSIGN_VALUE))
    value_start = (F.col("end") - F.length("value")).alias("value_start")  # every pattern's value ends its match
    return placed.select("id", "tag", "repo", "owner", "order", "kind", (F.col("end") - F.col("size")).alias("start"), "end", value_start, F.sha2(F.col("value").cast("binary"), 256).alias("value_hash"), live_looking(F.col("value")).alias("looks_live"))


def ownership(placed: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners over the whole corpus. A null is told from every name."""
    named = placed.select("value_hash", F.struct("repo").alias("repo"), F.struct("owner").alias("owner"))
    # Distinct first, so that a value that is everywhere is counted from many partial sums.
    owners = named.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    repos = named.select("value_hash", "repo").distinct().groupBy("value_hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value_hash")


def judged(placed: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The spans with n_repos, n_owners, live (live-looking, of few owners and few repositories) and reported."""
    out = placed.join(ownership(placed), "value_hash")
    out = out.withColumn("live", F.col("looks_live") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    return out.withColumn("reported", F.col("kind").isin(*BASE) | F.col("live"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """For each row of docs: id_col and its reported spans, an array of (start, order, kind, end, n_repos, n_owners, live) in that order."""
    found = candidates(docs, id_col, text_col, repo_col, owner_col)
    shown = judged(spans(found), max_owners, max_repos).where("reported")
    per_row = shown.groupBy("id", "tag", "repo", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end", "n_repos", "n_owners", "live"))).alias("spans"))
    left, right = found.select("id", "tag", "repo", "owner").alias("l"), per_row.alias("r")
    same = F.lit(True)
    for c in ("id", "tag", "repo", "owner"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    empty = F.array().cast(per_row.schema["spans"].dataType)
    return left.join(right, same, "left").select(F.col("l.id").alias(id_col), F.coalesce("r.spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with MARK in the place of each live value; what overlapping values cover is one place.

    One pass looks for candidates and writes the rows to the work folder, those with candidates apart. Only
    these few are counted, joined with the verdicts and rewritten; all others pass as they are.
    """
    text = F.col(f"`{text_col}`")
    seen = docs.select("*", *[matches(F.coalesce(text, F.lit("")), k).alias(f"__{k}") for k in KINDS])
    staged = seen.withColumn("__some", reduce(lambda a, b: a | b, [F.size(f"__{k}") > 0 for k in KINDS]).cast("int"))
    folder = f"{work_folder(docs.sparkSession)}/secrets-{uuid.uuid4().hex}"
    staged.write.partitionBy("__some").parquet(folder)
    staged = docs.sparkSession.read.schema(staged.schema).parquet(folder)
    some, rest = staged.where("__some = 1"), staged.where("__some = 0")

    tag = F.xxhash64(text, F.length(text))
    found = some.select(F.col(f"`{id_col}`").alias("id"), tag.alias("tag"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.col(f"`{owner_col}`").cast("string").alias("owner"), *[F.col(f"__{k}").alias(k) for k in KINDS])
    live = judged(spans(found), max_owners, max_repos).where("live")
    live = live.groupBy("id", "tag").agg(F.array_sort(F.collect_set(F.struct("value_start", "end"))).alias("__live"))
    live = live.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "__live")
    some = some.join(live, some[id_col].eqNullSafe(live["__id"]) & (tag == live["__tag"]), "left")
    some = some.withColumn(text_col, F.when(F.col("__live").isNull(), text).otherwise(masked(text, F.col("__live"))))
    kept = [f"`{c}`" for c in docs.columns]
    return some.select(*kept).unionByName(rest.select(*kept))


def masked(text: Column, spans: Column) -> Column:
    """The text with MARK in the place of each run that the sorted spans (value_start, end) cover; spans may overlap."""

    def add(done: Column, s: Column) -> Column:
        shown = F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), (s["value_start"] - done["at"]).cast("int")), F.lit(MARK))
        inside = done["any"] & (s["value_start"] <= done["at"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.lit(True).alias("any"), F.when(inside, done["out"]).otherwise(shown).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("any"), F.lit("").alias("out"))
    return F.aggregate(spans, start, add, lambda d: F.concat(d["out"], text.substr((d["at"] + 1).cast("int"), F.length(text))))
