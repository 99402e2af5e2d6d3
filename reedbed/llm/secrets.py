"""Secret scans: spans of credentials, and corpus-wide ownership frequency. Spark SQL expressions only.

Candidates are found in each text; hashes of their values are then counted over distinct owners and distinct repositories
of the whole corpus. A value under few owners and in few repositories is a live-looking credential of theirs; one that
many owners or many repositories hold is a widely copied example. Base spans (assign, access, hex) always stay; long
opaque strings are spans only if they are live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import bind
from .store import Workspace

# The kinds in the order that breaks ties, and their patterns.
KINDS = ["assign", "access", "hex", "opaque"]
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""[dDtTnNyY]["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
MAX_OWNERS = 2  # owners of a live value
MAX_REPOS = 3  # repositories of a live value
BLOCK = 256  # entries of an array that are gone through at once
NONE = -(1 << 30)  # below all places
SALTS = 16  # parts that the occurrences of a value are dealt into when they meet its counts


def running(values: Column, combine: Callable[[Column, Column], Column], none: int) -> Column:
    """For each entry of an array of ints, all entries up to it combined (a sum or a maximum); none changes nothing.

    Arrays go by blocks: inside a block, over the blocks' last values, and then both together, since an array that grows by
    one entry is copied each time.
    """

    def scan(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(combine(x, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(none))))))

    def parts(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: scan(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))

    def whole(blocks: Column) -> Column:
        ends = scan(F.transform(blocks, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(none))))
        return bind(ends, lambda e: F.flatten(F.transform(blocks, lambda x, k: F.transform(x, lambda y: combine(y, F.coalesce(F.get(e, k - 1), F.lit(none)))))))

    return bind(values, lambda v: bind(parts(v), whole))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _places(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all leftmost non-overlapping matches, those whose group has fewer than least characters dropped.

    The texts between matches (split) and the matches give each match's place by running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def spans(x: Column) -> Column:
        moves = F.transform(x["hits"], lambda h, i: F.get(x["gaps"], i) + F.length(h))
        placed = bind(running(moves, _sum, 0), lambda ends: F.transform(x["hits"], lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), F.get(x["values"], i).alias("val"))))
        return F.filter(placed, lambda s: F.length(s["val"]) >= least)

    return bind(F.struct(found.alias("hits"), value.alias("values"), gaps.alias("gaps")), spans)


def _apart(base: Column, opaque: Column) -> Column:
    """The spans of opaque that overlap none of base, both in one sorted list: no base span before goes beyond a span's start,
    and none after starts before its end."""

    def extra(both: Column) -> Column:
        ends = running(F.transform(both, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(-1)), F.greatest, -1)
        starts = F.reverse(running(F.transform(F.reverse(both), lambda s: F.when(s["kind"] < 3, -s["start"]).otherwise(NONE)), F.greatest, NONE))
        return bind(F.struct(ends.alias("ends"), starts.alias("starts")), lambda x: F.filter(both, lambda s, i: (s["kind"] == 3) & (F.get(x["ends"], i) <= s["start"]) & (-F.get(x["starts"], i) >= s["end"])))

    return F.when(F.size(opaque) == 0, opaque).otherwise(bind(F.sort_array(F.concat(base, opaque)), extra))


def _looks_random(value: Column) -> Column:
    """At least four digits, four letters and ten different characters."""
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def _spans(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int,val:string>>")
    assign = F.when(text.rlike(ASSIGN_HINT), _places(text, ASSIGN, 0, 2, 12)).otherwise(none)
    access = F.when(text.contains("AKIA"), _places(text, ACCESS, 1, 0, 18)).otherwise(none)
    hexes = F.when(text.rlike("[0-9a-f]{16}"), _places(text, HEX, 2, 0, 16)).otherwise(none)
    opaque = F.when(text.rlike("[A-Za-z0-9+/_-]{24}"), _places(text, OPAQUE, 3, 0, 24)).otherwise(none)
    base = F.sort_array(F.concat(assign, access, hexes))
    return bind(F.struct(base.alias("base"), F.filter(opaque, lambda o: _looks_random(o["val"])).alias("random")), lambda x: F.struct(x["base"].alias("base"), _apart(x["base"], x["random"]).alias("extra")))


def _hashed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["val"]).alias("value")))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """doc_id, th (the text's hash), base and spans (arrays of start, kind, end), n_live, n_example; one row per row of docs.

    An owner is a value of owner_col; a repository is an owner and a value of repo_col. Null text is empty; a null owner
    is an owner. Rows that repeat an id and a text have one outcome. Other columns are ignored. An empty table gives an
    empty table.
    """
    space = Workspace(docs.sparkSession, "secrets")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = docs.select("doc_id", "owner", "repo", F.xxhash64("text").alias("th"), _spans(F.col("text")).alias("s"))
    found = space.keep(found.select("doc_id", "owner", "repo", "th", _hashed(F.col("s.base")).alias("base"), _hashed(F.col("s.extra")).alias("extra")), "spans")
    each = found.select("doc_id", "owner", "repo", "th", F.explode(F.concat("base", "extra")).alias("s")).select("doc_id", "owner", "repo", "th", "s.*")
    repos = each.groupBy("value", "owner", "repo").count()
    owners = repos.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    use = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.drop("owner", "repo").distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    judged = salted.join(use, ["value", "salt"]).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    per_doc = judged.groupBy("doc_id", "th").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("more"),
    )
    thin = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined = found.alias("f").join(per_doc.alias("p"), (F.col("f.th") == F.col("p.th")) & F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    return joined.select("f.doc_id", "f.th", thin(F.col("base")).alias("base"), F.sort_array(F.concat(thin(F.col("base")), F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example), one row per row of docs.

    Null and empty texts have no spans; null owners, repositories and ids are values like others; rows that repeat an id
    and a text repeat their row; other columns are ignored; an empty table gives an empty table.
    """
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return secret_spans(docs).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the union of each text's spans replaced by mark; n_chars, where there is one, follows the text.

    No row is dropped: null texts stay null, repeated rows stay repeated, all other columns are kept as they are.
    """
    spans = secret_spans(docs).filter("size(spans) > 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__of"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__of"])
    own = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(spans, (F.col("__th") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")

    def blanked(x: Column) -> Column:
        """The text between spans (from, to), joined by the mark; cut by way of longer pieces, since a cut costs its distance."""
        last = F.floor((F.size(x["gaps"]) - 1) / BLOCK).cast("int")

        def piece(k: Column) -> Column:
            own = F.slice(x["gaps"], k * BLOCK + 1, F.lit(BLOCK))
            start = F.get(x["gaps"], k * BLOCK)["from"]
            long = F.substring(F.col("text"), start + 1, F.get(own, F.size(own) - 1)["to"] - start)
            return bind(F.struct(long.alias("long"), start.alias("start")), lambda y: F.transform(own, lambda g: F.substring(y["long"], g["from"] - y["start"] + 1, g["to"] - g["from"])))

        between = F.flatten(F.transform(F.sequence(F.lit(0), last), piece))
        return F.array_join(F.concat(between, F.array(F.substring(F.col("text"), x["at"] + 1, F.length("text")))), mark)

    def gaps(ends: Column) -> Column:
        each = F.transform("__spans", lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("from"), s["start"].alias("to")))
        return F.struct(F.filter(each, lambda g: g["to"] >= g["from"]).alias("gaps"), F.get(ends, F.size(ends) - 1).alias("at"))

    cut = bind(bind(running(F.transform("__spans", lambda s: s["end"]), F.greatest, 0), gaps), blanked)
    joined = joined.withColumn("__new", F.when(F.col("__spans").isNotNull(), cut))
    new = {"text": F.coalesce("__new", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
