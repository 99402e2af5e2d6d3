"""Bibliographies: parsing, resolution against two indexes, links to papers already held, overlays on pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import arxiv_as_doi, content_words, match_query, normalize_doi, paper_key, plausible_year, safe_url, strip, words_match, year_distance
from ..sources.shared import kept
from .title_search import top_titles

YEAR_LIMIT = 3
FIELDS = ["title", "authors", "year", "venue", "abstract", "citations", "doi", "url", "pdf_url", "source"]  # of a record, in order
ABOVE, BELOW = -0.012, 0.06
SLACK = 1e-9  # that bins are wider by than the distances that count
STALE = "INTERVAL 15 MINUTES"


def analysis_queue(editions: DataFrame, now: Column) -> DataFrame:
    """Editions to analyse: never tried, or pending without a stamp or for more than 15 minutes."""
    return editions.filter(F.col("references_status").isNull() | ((F.col("references_status") == "pending") & (F.col("references_at").isNull() | (F.col("references_at") < now - F.expr(STALE)))))


def refresh_analysis(editions: DataFrame, ids: DataFrame) -> DataFrame:
    """editions with the status of those in ids taken back to none."""
    rows = editions.join(ids.select("id", F.lit(True).alias("__again")).distinct(), "id", "left")
    return rows.withColumn("references_status", F.when(F.col("__again").isNull(), F.col("references_status"))).select(*editions.columns)


def resolution_queue(refs: DataFrame) -> DataFrame:
    return refs.filter("resolved_status is null")


def store_resolutions(refs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """refs with outcomes (id, status, work_id) stored; an error is not, so that it is tried again."""
    rows = refs.join(outcomes.filter("status in ('ok', 'miss')").select("id", F.col("status").alias("__s")), "id", "left")
    return rows.withColumn("resolved_status", F.coalesce("__s", "resolved_status")).drop("__s")


def hashed_words(text: Column | str) -> Column:
    """content_words as 64-bit hashes, by which words are compared here."""
    return F.transform(content_words(text), lambda w: F.xxhash64(w))


def with_words(refs: DataFrame) -> DataFrame:
    """refs with hay, the words of the printed line and parsed title: cut once, before any pairing."""
    return refs.withColumn("hay", hashed_words(F.concat_ws(" ", "raw", "title")))


def accepted(pairs: DataFrame) -> DataFrame:
    pairs = pairs.withColumn("distance", year_distance("work_year", "year"))
    return pairs.filter(words_match(F.col("work_words"), F.col("hay")))


def work_columns(works: DataFrame) -> DataFrame:
    return works.select(F.col("id").alias("work_id"), F.col("doi").alias("work_doi"), F.col("title").alias("work_title"), F.col("year").alias("work_year"), "source_rank", hashed_words("title").alias("work_words"))


def resolve_by_identifier(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(id, work_id, distance, via): references whose DOI, else arXiv number, names a work whose title and year agree.

    refs: with hay or not. works: as they are or as work_columns gives them."""
    w = works if "work_words" in works.columns else work_columns(works)
    own = refs if "hay" in refs.columns else with_words(refs)
    keyed = own.select("id", "year", "hay", F.explode(F.array(F.struct(F.lit(0).alias("via"), normalize_doi("doi").alias("k")), F.struct(F.lit(1).alias("via"), arxiv_as_doi("arxiv_id").alias("k")))).alias("x")).select("id", "year", "hay", "x.via", "x.k").filter("k is not null and k <> ''")
    hits = accepted(keyed.join(w.withColumn("k", normalize_doi("work_doi")), "k")).filter(F.col("distance") <= YEAR_LIMIT)
    best = hits.groupBy("id").agg(F.min(F.struct("via", "source_rank", "work_id", "distance")).alias("b"))
    return best.select("id", "b.work_id", "b.distance", "b.via")


def first_query() -> Column:
    """What the first index is asked: the printed line without addresses and arXiv notes."""
    return match_query("raw")


def second_query(min_len: int = 8) -> Column:
    """What the second index is asked: the parsed title, else the printed line, of min_len characters at least."""
    text = F.regexp_replace(strip(F.coalesce(F.nullif("title", F.lit("")), "raw")), r"(?U)\s+", " ")
    return F.when(F.length(text) >= min_len, text)


def candidates(refs: DataFrame, works: DataFrame, k: int = 5, min_len: int = 8, text: Column | None = None, words: Column | None = None) -> DataFrame:
    """(id, work_id, common, rank): up to k works of each reference by common title words; see title_search.

    Ranks go by common words, then work id. text is what a reference is searched by, null or empty for no search; without it,
    the printed line and the parsed title together, for references with min_len characters to search by at least. words: the
    same as hashed_words, where they are cut already. works: as they are or as work_columns gives them.
    """
    if words is None:
        words = hashed_words(F.when(F.length(F.coalesce("title", "raw")) >= min_len, F.concat_ws(" ", "raw", "title")) if text is None else text)
    cut = works if "work_words" in works.columns else works.select(F.col("id").alias("work_id"), hashed_words("title").alias("work_words"))
    return top_titles(refs.select("id", words.alias("words")), cut.select("work_id", F.col("work_words").alias("words")), k)


def best_candidate(cands: DataFrame, limit: int = YEAR_LIMIT) -> DataFrame:
    """Per reference the least (year distance, index, rank); none if even that is more than limit years off.

    cands: id, work_id, distance, source_rank, rank.
    """
    best = cands.groupBy("id").agg(F.min(F.struct("distance", "source_rank", "rank", "work_id")).alias("b"))
    return best.filter(F.col("b.distance") <= limit).select("id", "b.work_id", "b.distance", "b.source_rank")


def merge_works(primary: str, secondary: str, printed_year: Column) -> Column:
    """Fields of two work structs: the first that is not empty, zero or missing; the year printed, if one has it."""
    p, s = F.col(primary), F.col(secondary)
    out = {}
    for name in ("title", "authors", "venue", "abstract", "citations", "doi", "url", "pdf_url", "source"):
        a, b = p[name], s[name]
        full = F.size(a) > 0 if name == "authors" else (a != 0 if name == "citations" else F.length(a) > 0)
        out[name] = F.when(F.coalesce(full, F.lit(False)), a).otherwise(b)
    out["year"] = F.when(p["year"] == printed_year, p["year"]).when(s["year"] == printed_year, s["year"]).otherwise(F.coalesce(F.nullif(p["year"], F.lit(0)), s["year"]))
    return F.struct(*(out[f].alias(f) for f in FIELDS))


def resolve_references(refs: DataFrame, works: DataFrame, k: int = 5, second_available: bool = True) -> DataFrame:
    """(id, status, work_id, distance, via): identifier first, else the best title candidate.

    Candidates of the second index (source_rank 1) count only where the first has none of the printed year. A reference
    that needed the second index while it was out, and has nothing, is an error; nothing else found is a miss.
    """
    # Lines are cut into words once, and what several steps ask of them is written.
    own = kept(with_words(refs).select("id", "year", "doi", "arxiv_id", "hay", (F.length(F.coalesce("title", "raw")) >= 8).alias("asked")), "words")
    w = kept(work_columns(works).drop("work_title"), "works")
    known = kept(resolve_by_identifier(own, w), "known")
    open_ = own.join(known.select("id"), "id", "left_anti")

    def judged(rank: int) -> DataFrame:
        part = candidates(open_, w.filter(F.col("source_rank") == rank), k, words=F.when(F.col("asked"), F.col("hay")))
        pairs = part.join(w, "work_id").join(open_.select("id", "year", "hay"), "id")
        return accepted(pairs).select("id", "work_id", "distance", "source_rank", "rank")

    first = kept(judged(0), "judged")
    sure = first.filter("distance = 0").select("id").distinct()
    both = first.union(judged(1).join(sure, "id", "left_anti")) if second_available else first
    best = best_candidate(both).select("id", "work_id", "distance", F.lit("title").alias("via"))
    found = known.select("id", "work_id", "distance", F.when(F.col("via") == 0, "doi").otherwise("arxiv").alias("via")).union(best)
    out = own.select("id").join(found, "id", "left").join(sure.withColumn("sure", F.lit(True)), "id", "left")
    none = F.lit("miss") if second_available else F.when(F.col("sure").isNull(), "error").otherwise("miss")
    return out.select("id", F.when(F.col("work_id").isNotNull(), "ok").otherwise(none).alias("status"), "work_id", "distance", "via")


def _by_doi(works: DataFrame) -> DataFrame:
    """(k, work_id, found): the record of each DOI, of the work with the least id."""
    return works.select(normalize_doi("record.doi").alias("k"), F.struct("id", "record").alias("w")).filter("k is not null and k <> ''").groupBy("k").agg(F.min_by("w", "w.id").alias("w")).select("k", F.col("w.id").alias("work_id"), F.col("w.record").alias("found"))


def resolve_records(refs: DataFrame, first: DataFrame, second: DataFrame, k: int = 5, second_available: bool = True) -> DataFrame:
    """(id, status, via, distance, work_id, enriched, record): each reference's work with its whole record.

    refs: id, raw, title, year, doi, arxiv_id. first and second are the two indexes: id, record (a struct of WORK). In turn:
    1. the record that the second index has under the reference's DOI, then under its arXiv number, if title and year agree;
    2. what the first index finds for the printed line, and, unless one of that is of the printed year, what the second finds
       for the title: the nearest in year, then of the first index, then the best found. A farther one than YEAR_LIMIT is none;
    3. a winner of the first index with a DOI that the second knows is merged with that record, if what comes out still has the
       title and year of the reference.
    Nothing found is a miss; it is an error, to be tried again, if the second index was asked while it was out. An index is
    searched by bounds (see title_search); records only travel for the works that are chosen.
    """
    plain = lambda works, rank: works.select("id", F.col("record.doi").alias("doi"), F.col("record.title").alias("title"), F.col("record.year").alias("year"), F.lit(rank).alias("source_rank"))
    # Lines are cut into words once for each text that is searched by, and what several steps ask of them is written.
    own = kept(with_words(refs).select("id", "year", "doi", "arxiv_id", "hay", hashed_words(first_query()).alias("asked"), (F.lit(False) if second_available else second_query().isNotNull()).alias("titled")), "words")
    one_words, two_words = (work_columns(plain(works, rank)).drop("work_title") for rank, works in enumerate((first, second)))
    one_words = kept(one_words, "works")
    two_words = kept(two_words, "works") if second_available else two_words
    known = resolve_by_identifier(own, two_words)
    known = kept(known, "known") if second_available else known.limit(0)
    open_ = own.join(known.select("id"), "id", "left_anti")

    def judged(works: DataFrame, asked: DataFrame) -> DataFrame:
        pairs = candidates(asked, works, k, words=F.col("asked")).join(works, "work_id").join(own.select("id", "year", "hay"), "id")
        return accepted(pairs).select("id", "work_id", "distance", "source_rank", "rank")

    found = kept(judged(one_words, open_), "judged")
    sure = found.filter("distance = 0").select("id").distinct()
    both = found
    if second_available:
        unsure = open_.select("id").join(sure, "id", "left_anti")
        both = found.union(judged(two_words, refs.select("id", hashed_words(second_query()).alias("asked")).join(unsure, "id", "left_semi")))
    best = kept(best_candidate(both), "best")

    printed = own.select("id", F.col("year").alias("printed"), "hay")
    one = best.filter("source_rank = 0").join(first.select(F.col("id").alias("work_id"), "record"), "work_id").join(printed, "id")
    if second_available:
        one = one.withColumn("k", normalize_doi("record.doi")).join(_by_doi(second).drop("work_id"), "k", "left")
        one = one.withColumn("merged", F.when(F.col("found").isNotNull(), merge_works("found", "record", F.col("printed"))))
        holds = words_match(hashed_words("merged.title"), F.col("hay")) & (year_distance("merged.year", "printed") <= YEAR_LIMIT)
        one = one.withColumn("enriched", F.coalesce(F.col("merged").isNotNull() & holds, F.lit(False))).withColumn("record", F.when(F.col("enriched"), F.col("merged")).otherwise(F.col("record")))
    else:
        one = one.withColumn("enriched", F.lit(False))
    columns = ["id", "work_id", "distance", "via", "enriched", "record"]
    one = one.withColumn("via", F.lit("first")).select(columns)
    rest = best.filter("source_rank = 1").select("id", "work_id", "distance", F.lit("second").alias("via"))
    rest = rest.union(known.select("id", "work_id", "distance", F.when(F.col("via") == 0, "doi").otherwise("arxiv")))
    two = rest.join(second.select(F.col("id").alias("work_id"), "record"), "work_id").withColumn("enriched", F.lit(False)).select(columns)
    out = own.select("id", "doi", "arxiv_id", "titled").join(one.union(two), "id", "left").join(sure.withColumn("sure", F.lit(True)), "id", "left")
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    asked = F.lit(False) if second_available else has(F.col("doi")) | has(F.col("arxiv_id")) | (F.col("sure").isNull() & F.col("titled"))
    status = F.when(F.col("work_id").isNotNull(), "ok").when(asked, "error").otherwise("miss")
    return out.select("id", status.alias("status"), "via", "distance", "work_id", F.coalesce("enriched", F.lit(False)).alias("enriched"), "record")


def store_records(refs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """refs with resolved_status, resolved_at and resolution taken from outcomes (id, status, record). An error changes nothing,
    so that the reference stays in the queue."""
    done = outcomes.filter("status in ('ok', 'miss')").select("id", F.col("status").alias("__s"), F.col("record").alias("__r"))
    new = {"resolved_status": F.col("__s"), "resolved_at": now, "resolution": F.to_json("__r")}
    rows = refs.join(done, "id", "left")
    return rows.select(*(F.when(F.col("__s").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in refs.columns))


def library_match(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, paper_id): references that name a paper held; the DOI key first, then the title key; least paper id a key.

    refs: id, doi, title, resolved_doi, resolved_title; what was resolved counts before what was parsed.
    """
    own = papers.select(paper_key("doi", "title").alias("k"), F.col("id").alias("paper_id")).groupBy("k").agg(F.min("paper_id").alias("paper_id"))
    doi, title = normalize_doi(F.coalesce("resolved_doi", "doi")), F.coalesce("resolved_title", "title")
    keys = F.array(F.when(F.length(doi) > 0, F.struct(F.lit(0).alias("n"), paper_key(doi, F.lit("")).alias("k"))), F.when(F.length(title) > 0, F.struct(F.lit(1).alias("n"), paper_key(F.lit(None).cast("string"), title).alias("k"))))
    each = refs.select("id", F.explode(F.array_compact(keys)).alias("x")).select("id", "x.n", "x.k")
    return each.join(own, "k").groupBy("id").agg(F.min(F.struct("n", "paper_id"))["paper_id"].alias("paper_id"))


def link_references(links: DataFrame, refs: DataFrame) -> DataFrame:
    """(link_id, ref_id): the reference that a PDF link lands on: on its page, from 0.012 above to 0.06 below, the nearest.

    References of one place on a page are one, the first in the list, and links of one place are judged once. A page is cut into
    bins of that height; a place meets the references of the one or two bins that it can land in, so that a page of very many
    references is many small groups. Of equally near references the first in the list wins.
    """
    height, place = BELOW - ABOVE, ["edition_id", "page", "y"]
    r = refs.filter("y is not null").groupBy(*place).agg(F.min("id").alias("ref_id")).withColumnRenamed("y", "ref_y").withColumn("bin", F.floor(F.col("ref_y") / height))
    bins = F.sequence(F.floor((F.col("y") + ABOVE - SLACK) / height), F.floor((F.col("y") + BELOW + SLACK) / height))
    own = links.filter("y is not null").select(F.col("id").alias("link_id"), *place)
    near = own.select(*place).distinct().withColumn("bin", F.explode(bins)).join(r, ["edition_id", "page", "bin"]).withColumn("drop", F.col("ref_y") - F.col("y")).filter(F.col("drop").between(ABOVE, BELOW))
    best = near.groupBy(*place).agg(F.min(F.struct(F.abs("drop").alias("d"), "ref_id")).alias("b"))
    return own.join(best, place).groupBy("link_id").agg(F.min("b")["ref_id"].alias("ref_id"))


def page_overlays(citations: DataFrame, link_hits: DataFrame) -> DataFrame:
    """Per page the citations of PDF links, if there are any, else the analyser's boxes; exact unless inferred."""
    other = citations.join(link_hits.select("edition_id", "page").distinct(), ["edition_id", "page"], "left_anti")
    cols = ["edition_id", "page", "reference_id"]
    return link_hits.select(*cols, F.lit(True).alias("exact"), F.lit("link").alias("origin")).union(other.select(*cols, ~F.col("inferred"), F.lit("analyser")))


def classify_links(links: DataFrame, refs: DataFrame) -> DataFrame:
    """links (id, edition_id, page, y, url) with kind: citation, web, jump; those that lead nowhere are dropped."""
    rows = links.join(link_references(links, refs), links["id"] == F.col("link_id"), "left").drop("link_id")
    kind = F.when(F.col("ref_id").isNotNull(), "citation").when(safe_url("url").isNotNull(), "web").when(F.col("url").isNull() & F.col("y").isNotNull(), "jump")
    return rows.withColumn("kind", kind).filter("kind is not null")


def numbered_targets(markers: DataFrame, refs: DataFrame) -> DataFrame:
    """(marker_id, reference_id, inferred): markers' targets by key, else by the number in brackets; others are dropped.

    markers: id, edition_id, target, label. refs: id, edition_id, key, index (from 0).
    """
    by_key = refs.groupBy("edition_id", F.col("key").alias("target")).agg(F.max("id").alias("by_key"))
    by_number = refs.groupBy("edition_id", "index").agg(F.max("id").alias("by_number"))
    number = F.regexp_extract(F.coalesce("label", F.lit("")), r"[\[(]\s*(\d{1,3})", 1)
    rows = markers.join(by_key, ["edition_id", "target"], "left").withColumn("index", F.when(number != "", number.cast("int") - 1)).join(by_number, ["edition_id", "index"], "left")
    return rows.select(F.col("id").alias("marker_id"), F.coalesce("by_key", "by_number").alias("reference_id"), F.col("by_key").isNull().alias("inferred")).filter("reference_id is not null")


def page_boxes(coords: DataFrame, sizes: DataFrame) -> DataFrame:
    """coords (id, edition_id, coords 'page,x,y,w,h;...') -> a row for each box, in fractions of its page's size."""
    part = lambda k: F.get("p", F.lit(k)).try_cast("double")
    boxes = coords.select("id", "edition_id", F.explode(F.split("coords", ";")).alias("box")).withColumn("p", F.split("box", ",")).filter("size(p) = 5")
    boxes = boxes.select("id", "edition_id", F.get("p", F.lit(0)).try_cast("int").alias("page"), *(part(k).alias(n) for k, n in ((1, "x"), (2, "y"), (3, "w"), (4, "h")))).filter("page is not null and x is not null and y is not null and w is not null and h is not null")
    rows = boxes.join(sizes.filter("width > 0 and height > 0"), ["edition_id", "page"])
    return rows.select("id", "edition_id", "page", (F.col("x") / F.col("width")).alias("x"), (F.col("y") / F.col("height")).alias("y"), (F.col("w") / F.col("width")).alias("w"), (F.col("h") / F.col("height")).alias("h"))


def edition_bundle(editions: DataFrame, refs: DataFrame, cites: DataFrame, analyser: bool = True) -> DataFrame:
    """(edition_id, status, references, citations): arrays for ready editions, empty ones for others."""
    own = refs.groupBy("edition_id").agg(F.sort_array(F.collect_list(F.struct("index", "id", "raw", F.try_parse_json("resolution").cast("string").alias("resolution")))).alias("references"))
    marks = cites.filter("reference_id is not null").groupBy("edition_id").agg(F.sort_array(F.collect_list(F.struct("page", "id", "reference_id"))).alias("citations"))
    rows = editions.select(F.col("id").alias("edition_id"), F.col("references_status").alias("status")).join(own, "edition_id", "left").join(marks, "edition_id", "left")
    ready = F.col("status") == "ready"
    status = F.coalesce("status", F.lit("pending") if analyser else F.lit("unavailable"))
    return rows.select("edition_id", status.alias("status"), F.when(ready, F.col("references")).alias("references"), F.when(ready, F.col("citations")).alias("citations")).select("edition_id", "status", F.coalesce("references", F.array()).alias("references"), F.coalesce("citations", F.array()).alias("citations"))


TEI = "{http://www.tei-c.org/ns/1.0}"
REFERENCE_ROWS = "edition_id long, status string, key string, index int, raw string, title string, authors string, journal string, year_when string, year_text string, doi string, arxiv_id string, coords string"
MARKER_ROWS = "edition_id long, status string, marker int, target string, label string, coords string"


def _text(node: ET.Element | None) -> str | None:
    joined = " ".join("".join(node.itertext()).split()) if node is not None else ""
    return joined or None


def _tree(xml: str) -> ET.Element | None:
    try:
        return ET.fromstring(xml or "")
    except ET.ParseError:
        return None


def _reference_row(edition: int, index: int, entry: ET.Element) -> tuple:
    title = next((_text(t) for level in ("a", "m", None) for t in entry.iter(f"{TEI}title") if (level is None or t.get("level") == level) and _text(t)), None)
    journal = next((_text(t) for t in entry.iter(f"{TEI}title") if t.get("level") == "j"), None)
    names = [" ".join(filter(None, (_text(p) for p in person if p.tag in (f"{TEI}forename", f"{TEI}surname")))) for person in entry.iter(f"{TEI}persName")]
    date = next(entry.iter(f"{TEI}date"), None)
    ids = {(i.get("type") or "").lower(): _text(i) for i in entry.iter(f"{TEI}idno")}
    raw = next((_text(n) for n in entry.iter(f"{TEI}note") if n.get("type") == "raw_reference"), None)
    key = entry.get("{http://www.w3.org/XML/1998/namespace}id")
    return edition, "ready", key, index, raw, title, ", ".join(filter(None, names)) or None, journal, date.get("when") if date is not None else None, _text(date), ids.get("doi"), ids.get("arxiv"), entry.get("coords")


def tei_references(docs: DataFrame) -> DataFrame:
    """Bibliography entries of TEI documents (edition_id, xml); of entries with one key the last counts.

    Key-less entries are left out and not counted by index. A document that is no XML gives one row of status failed.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for edition, xml in zip(pdf["edition_id"], pdf["xml"], strict=True):
                tree = _tree(xml)
                if tree is None:
                    rows.append((edition, "failed", *[None] * 11))
                    continue
                entries = [e for e in tree.iter(f"{TEI}biblStruct") if e.get("{http://www.w3.org/XML/1998/namespace}id")]
                own = {r[2]: r for r in (_reference_row(edition, k, e) for k, e in enumerate(entries))}
                rows += own.values()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFERENCE_ROWS.split(", ")]).astype({"index": "Int32"})

    rows = docs.select("edition_id", "xml").mapInPandas(parse, REFERENCE_ROWS)
    return rows.select(*(c for c in rows.columns if not c.startswith("year_")), plausible_year(F.col("year_when"), F.col("year_text")).alias("year"))


def tei_citations(docs: DataFrame) -> DataFrame:
    """In-text markers of TEI documents: target key, label and boxes as printed (page_boxes makes rows of them)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for edition, xml in zip(pdf["edition_id"], pdf["xml"], strict=True):
                tree = _tree(xml)
                if tree is None:
                    rows.append((edition, "failed", None, None, None, None))
                    continue
                marks = [r for r in tree.iter(f"{TEI}ref") if r.get("type") == "bibr"]
                rows += [(edition, "ready", k, (r.get("target") or "").lstrip("#") or None, _text(r), r.get("coords")) for k, r in enumerate(marks)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MARKER_ROWS.split(", ")]).astype({"marker": "Int32"})

    return docs.select("edition_id", "xml").mapInPandas(parse, MARKER_ROWS)
