"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by one pattern a kind. Each candidate value is hashed, and its hash is counted
over distinct repositories and distinct owners of the whole corpus. A value is a copied example if
more than MOST_OWNERS owners have it and it stands in more than MOST_REPOS repositories: many owners
in few repositories share a credential, and few owners in many repositories repeat their own. Every
other value is live, of whatever length and alphabet. Base kinds are always reported; the method adds
a `live` span around each live value.

Positions are code points, the end exclusive. Nulls count as empty texts, which have no spans; a
null owner or repository is one of its own. Repeated rows are scanned each on its own and count as
one repository. Overlapping spans of different kinds are all reported; spans with one start go in the
order of their kinds. Texts are scanned whole, in time about linear in their matches. Extra columns,
whatever their names, stay as they are or are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import renamed, shared_folder, stored

#: Kinds in the order that breaks ties: pattern, group with the value, least length of the value.
BASE_KINDS = {
    "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
MORE_KINDS = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 34),
}
KINDS = BASE_KINDS | MORE_KINDS
ORDER = [*KINDS, "live"]
#: A value that more owners have than this, in more repositories than that, is a copied example.
MOST_OWNERS, MOST_REPOS = 5, 10
#: Matches of one text whose places are added up together.
PART = 256

SPAN = "struct<start:int,rank:int,kind:string,end:int,hash:string,value_start:int>"


def _found(kind: str, text: Column) -> Column:
    """All spans of a kind, from the pieces between the matches and the matches."""
    pattern, group, least = KINDS[kind]
    rank = ORDER.index(kind)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("all"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)).alias("value"))

    def step(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + F.length(piece["gap"])
        end = start + F.length(piece["all"])
        value = piece["value"]
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(value.cast("binary"), 256).alias("hash"), (end - F.length(value)).alias("value_start"),
        )
        enough = F.length(value) >= least
        return F.when(piece["all"].isNull(), so_far).otherwise(F.struct(end.alias("at"), F.when(enough, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans")))

    none = F.lit(None).cast(f"array<{SPAN}>")
    empty = F.coalesce(none, F.array().cast(f"array<{SPAN}>"))

    def walk(found: Column) -> Column:
        """Spans of each part from the part's start on, and the part's length."""
        first = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int"))
        return F.transform(first, lambda k: F.aggregate(F.slice(found, k * PART + 1, F.lit(PART)), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step))

    def moved(parts: Column) -> Column:
        """All spans, each part's moved by the lengths of those before it."""
        begin = F.aggregate(parts, F.array(F.lit(0)), lambda so_far, p: F.concat(so_far, F.array(F.element_at(so_far, -1) + p["at"])))
        by = lambda s, n: s.withField("start", s["start"] + n).withField("end", s["end"] + n).withField("value_start", s["value_start"] + n)
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(begin, F.lit(1), F.size(parts)).alias("begin")), lambda x: F.transform(x["part"]["spans"], lambda s: by(s, x["begin"]))))

    # one-element arrays name a value, so that it is worked out once
    walked = F.flatten(F.transform(F.array(pieces), lambda found: F.flatten(F.transform(F.array(walk(found)), moved))))
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `spans`: all candidates of a text in order of start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("spans", F.array_sort(F.concat(*(_found(k, text) for k in KINDS))))


def ownership(found: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """(hash, n_repos, n_owners) of every candidate value in a scanned table."""
    each = found.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.explode("spans").alias("s")).select("repo", "owner", F.col("s.hash").alias("hash"))
    both = each.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    repos = both.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = both.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


def judged(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the columns in keep, `spans` with the base and further kinds and `live` spans, n_live and n_example."""
    folder = shared_folder(docs.sparkSession)
    names = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*keep, repo_col, owner_col]))}
    rows = scan(docs, text_col).select(*(F.col(c).alias(n) for c, n in names.items()), "spans").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, folder, "found")
    hits = rows.where(F.size("spans") > 0)
    counted = stored(ownership(hits, names[repo_col], names[owner_col]), folder, "owners")
    each = hits.select("row", F.explode("spans").alias("s")).select("row", "s", F.col("s.hash").alias("hash"))
    example = (F.col("n_owners") > most_owners) & (F.col("n_repos") > most_repos)
    added = F.when(~example, F.struct(F.col("s.value_start").alias("start"), F.lit(ORDER.index("live")).alias("rank"), F.lit("live").alias("kind"), F.col("s.end").alias("end")))
    found = each.join(counted, "hash").groupBy("row").agg(F.collect_set(added).alias("live"), F.sum(F.when(example, 1).otherwise(0)).alias("n_example"))
    found = found.select(F.col("row").alias("of_row"), "live", "n_example")
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.array_sort(F.concat(plain, F.coalesce("live", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))))
    out = rows.join(found, F.col("row") == F.col("of_row"), "left").withColumn("spans", spans)
    n_live = F.size(F.filter("spans", lambda s: s["kind"] == "live")).cast("long")
    return out.select(*(F.col(names[c]).alias(c) for c in keep), "spans", n_live.alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, all spans, and the verdict's counts."""
    repo, owner, text = options.pop("repo_col", id_col), options.pop("owner_col", "source"), options.pop("text_col", "text")
    names = dict(zip(dict.fromkeys((id_col, repo, owner, text)), ("in0", "in1", "in2", "in3")))
    found = judged(docs.select(*(F.col(c).alias(n) for c, n in names.items())), names[text], names[repo], names[owner], keep=(names[id_col],), **options)
    id_col = names[id_col]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(id_col).alias("doc_id"), *map(count, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", repo_col: str = "doc_id", owner_col: str = "source", **options) -> DataFrame:
    """docs with every live value in its text replaced by a mark; other texts and columns stay as they are."""
    plain, own = renamed(docs)
    found = judged(plain, own[text_col], own[repo_col], own[owner_col], keep=tuple(plain.columns), **options)
    text = F.col(own[text_col])

    def step(so_far: Column, span: Column) -> Column:
        inside = span["start"] < so_far["at"]
        grown = F.concat(so_far["text"], text.substr(so_far["at"] + 1, span["start"] - so_far["at"]), F.lit(mark))
        return F.struct(F.when(inside, so_far["text"]).otherwise(grown).alias("text"), F.greatest(so_far["at"], span["end"]).alias("at"))

    walked = F.aggregate(F.filter("spans", lambda s: s["kind"] == "live"), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step)
    new = F.when(F.col("n_live") > 0, F.concat(walked["text"], text.substr(walked["at"] + 1, F.length(text)))).otherwise(text)
    return own.restore(found.withColumn(own[text_col], new))
