"""Concordance search: scope, candidate filter, matching with offsets, hits, snippets, pages.

Declarative parts (scope, prefilter, counts, snippets, dedup, paging) are DataFrame expressions. Matching
with offsets is inherently sequential within a text; it runs once per document that passed the prefilter,
in Arrow batches, and sends back hits only.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import canonical_parent, folder_of, normalised, overlaps_years, quoted, role_of

MODES = ("exact", "regex", "or", "proximity")
# What a search refuses.
MAX_TERMS, MAX_TERM_LENGTH, MAX_PATTERN_LENGTH = 10, 80, 1000
#: Roles that can be searched, in the order they are listed.
ROLES = ("canonical", "textual_variant", "reconstruction", "raw", "translation", "annotation", "derived_reading")
#: How much context the stored hits carry; a page cuts it to what was asked for.
STORED_CONTEXT = 200


@dataclass(frozen=True)
class SearchSpec:
    """What to search and where.

    Numbers out of range are brought into it. Queries that would have to be cut to be answered (no term, too
    long a term or pattern, fewer than two or more than ten terms, a pattern that does not compile) raise
    ValueError: nothing is dropped silently. Roles nobody can search are left out; without any, the canonical.
    """

    terms: tuple[str, ...]
    mode: str = "exact"
    punctuation: str = "ignore"
    span: int = 200
    order: str = "any"
    roles: tuple[str, ...] = ("canonical",)
    folders: tuple[str, ...] = ()
    exclude_folders: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)
    year_from: int | None = None
    year_to: int | None = None
    context: int = 20
    page: int = 1
    per_page: int = 20
    classes: tuple[str, ...] = ()
    deduplicate: bool = False
    #: A document on which a regular expression runs longer fails the search instead of holding a task for ever.
    regex_seconds: float = 30.0

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("terms", tuple(self.terms) if self.mode == "regex" else tuple(t.strip() for t in self.terms if t.strip()))
        put("span", min(max(self.span, 1), 5000))
        put("context", min(max(self.context, 0), 500))
        put("per_page", min(max(self.per_page, 1), 50))
        put("page", min(max(self.page, 1), 100_000))
        put("roles", tuple(r for r in ROLES if r in self.roles) or ("canonical",))
        put("folders", _paths(self.folders))
        put("exclude_folders", _paths(self.exclude_folders))
        put("metadata", {k: v.strip() for k, v in self.metadata.items() if v and v.strip()})
        for problem in self._problems():
            raise ValueError(problem)

    def _problems(self) -> Iterator[str]:
        if self.mode not in MODES:
            yield f"mode must be one of {MODES}"
        if self.order not in ("any", "entered"):
            yield "order must be any or entered"
        if self.punctuation not in ("ignore", "respect"):
            yield "punctuation must be ignore or respect"
        if self.mode == "regex":
            if len(self.terms) != 1 or not self.terms[0]:
                yield "one pattern is needed"
            elif len(self.terms[0]) > MAX_PATTERN_LENGTH:
                yield f"a pattern has at most {MAX_PATTERN_LENGTH} characters"
            else:
                try:
                    re.compile(self.terms[0])
                except re.error as e:
                    yield f"the pattern does not compile: {e}"
            return
        if self.mode == "exact" and len(self.terms) != 1:
            yield "one term is needed"
        if self.mode in ("or", "proximity") and not 2 <= len(self.terms) <= MAX_TERMS:
            yield f"two to {MAX_TERMS} terms are needed"
        if any(len(t) > MAX_TERM_LENGTH for t in self.terms):
            yield f"a term has at most {MAX_TERM_LENGTH} characters"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> SearchSpec:
        """The spec that ``to_dict`` (or its JSON) describes; unknown keys are refused."""
        lists = ("terms", "roles", "folders", "exclude_folders", "classes")
        return cls(**{k: tuple(v) if k in lists else v for k, v in values.items()})

    def cache_key(self) -> str:
        """A digest of what is searched; pages and context do not change it."""
        meaning = {k: v for k, v in self.to_dict().items() if k not in ("page", "per_page", "context", "regex_seconds")}
        return hashlib.sha256(json.dumps(meaning, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def _paths(values) -> tuple[str, ...]:
    return tuple(sorted({p for v in values if (p := v.strip().replace("\\", "/").strip("/"))}))


def in_scope(manifest: DataFrame, spec: SearchSpec) -> DataFrame:
    """Rows of a manifest (path, document_role, facets, years) within the scope; all conditions hold."""
    under = lambda folder: (F.col("folder_path") == folder) | F.col("folder_path").startswith(folder.rstrip("/") + "/")
    kept = manifest.where(F.col("document_role").isin(*spec.roles)) if spec.roles else manifest
    if spec.folders:
        inside = under(spec.folders[0])
        for f in spec.folders[1:]:
            inside = inside | under(f)
        kept = kept.where(inside)
    for f in spec.exclude_folders:
        kept = kept.where(~F.coalesce(under(f), F.lit(False)))
    for name, wanted in spec.metadata.items():
        kept = kept.where(F.exists(name, lambda x: x.contains(wanted)) if dict(manifest.dtypes)[name].startswith("array") else F.col(name).contains(wanted))
    return kept.where(overlaps_years(F.col("year_start"), F.col("year_end"), spec.year_from, spec.year_to))


def with_path_facts(manifest: DataFrame) -> DataFrame:
    """Add what the path says: role_from_path, folder_from_path, parent_from_path."""
    return manifest.withColumns({"role_from_path": role_of(F.col("path")), "folder_from_path": folder_of(F.col("path")), "parent_from_path": canonical_parent(F.col("path"))})


def prefilter(spec: SearchSpec, stream: Column) -> Column:
    """A cheap condition that every document with a hit meets: all terms (exact, proximity) or one (or)
    occur; equivalence classes count as one character. A regular expression is tested here only if it is
    built from nothing that Java and Python read differently; else every document is a candidate."""
    if spec.mode == "regex":
        return stream.rlike(spec.terms[0]) if read_alike(spec.terms[0]) else F.lit(True)
    tests = [stream.rlike(pattern_of(t, spec)) if spec.classes else stream.contains(t) for t in spec.terms]
    test = tests[0]
    for t in tests[1:]:
        test = (test | t) if spec.mode == "or" else (test & t)
    return test


# Letters, plain sets, groups, alternatives and counts. No escapes, dots, anchors, look-around or flags.
_PLAIN_PATTERN = re.compile(r"(?:[^\\\[\](){}*+?.^$|&~#\s]|\[\^?[^\\\[\]&~^\s-]+(?:-[^\\\[\]&~^\s-]+)*\]|\((?!\?)|\)|\||(?<![*+?}(|])(?:[*+?]|\{\d+(?:,\d*)?\}))+")


def read_alike(pattern: str) -> bool:
    """Whether Java and Python surely read a pattern the same way."""
    return bool(pattern) and _PLAIN_PATTERN.fullmatch(pattern) is not None


def pattern_of(term: str, spec: SearchSpec) -> str:
    """The term as a regular expression, each character widened to its equivalence class."""
    wide = {c: group for group in spec.classes for c in group}
    return "".join(f"[{''.join(map(quoted, wide[c]))}]" if c in wide else quoted(c) for c in term)


def overlapping(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Every start at which the pattern matches."""
    out, at = [], 0
    while (m := pattern.search(text, at)) and m.end() > m.start():
        out.append(m.span())
        at = m.start() + 1
    return out


def compact_windows(places: list[list[tuple[int, int]]], same: list[int], span: int) -> list[list[tuple[int, int, int]]]:
    """Smallest passages that hold every term, in any order.

    places: the occurrences of each distinct term; same: for each typed term the distinct term it is.
    For the event at which a passage ends, each term needs its last so-many events up to there; the passage
    starts at the earliest of those. Starts and ends both move forward from passage to passage. Of a term
    with events to spare, the first in the passage count. Returns (typed term, start, end) lists.
    """
    need = [same.count(d) for d in range(len(places))]
    events = sorted((s, e, d) for d, spans in enumerate(places) for s, e in spans)
    seen: list[list[int]] = [[] for _ in places]
    found, known, floor = [], set(), 0
    for right, (_, _, d) in enumerate(events):
        seen[d].append(right)
        if any(len(seen[k]) < need[k] for k in range(len(places))):
            continue
        left = min(seen[k][-need[k]] for k in range(len(places)))
        if left < floor:
            continue
        floor = left + 1
        chosen = []
        for k in range(len(places)):
            inside = [i for i in seen[k][-(right - left + 1) :] if i >= left][: need[k]]
            chosen += [(t, *events[i][:2]) for t, i in zip((t for t, x in enumerate(same) if x == k), inside)]
        chosen.sort()
        if max(e for _, _, e in chosen) - min(s for _, s, _ in chosen) <= span and tuple(chosen) not in known:
            known.add(tuple(chosen))
            found.append(chosen)
    return found


def ordered_windows(places: list[list[tuple[int, int]]], same: list[int], span: int) -> list[list[tuple[int, int, int]]]:
    """Passages with the terms in the order typed: from each occurrence of the first term on, each next
    term takes its first occurrence that starts no earlier and is not taken yet."""
    found, known = [], set()
    for first in places[same[0]]:
        chosen = [(0, *first)]
        for t, d in enumerate(same[1:], 1):
            taken = {(same[u], s) for u, s, _ in chosen}
            nxt = next((p for p in places[d] if p[0] >= chosen[-1][1] and (d, p[0]) not in taken), None)
            if nxt is None:
                break
            chosen.append((t, *nxt))
        else:
            if max(e for _, _, e in chosen) - min(s for _, s, _ in chosen) <= span and tuple(chosen) not in known:
                known.add(tuple(chosen))
                found.append(chosen)
    return found


def regex_spans(pattern: str, text: str, seconds: float) -> list[tuple[int, int]]:
    """Non-empty matches. Where the regex module is installed, a text that takes longer raises TimeoutError."""
    try:
        import regex
    except ImportError:
        return [m.span() for m in re.finditer(pattern, text) if m.end() > m.start()]
    return [m.span() for m in regex.finditer(pattern, text, timeout=seconds) if m.end() > m.start()]


def match_text(spec: SearchSpec, stream: str) -> list[list[tuple[int, int, int]]]:
    """Hits in a searchable stream, each a list of (term index, start, end)."""
    if not spec.terms:
        return []
    if spec.mode == "regex":
        return [[(0, *span)] for span in regex_spans(spec.terms[0], stream, spec.regex_seconds)]
    distinct = list(dict.fromkeys(spec.terms))
    places = [overlapping(re.compile(pattern_of(t, spec)), stream) for t in distinct]
    same = [distinct.index(t) for t in spec.terms]
    if spec.mode == "proximity":
        if len(same) < 2 or any(len(places[d]) < same.count(d) for d in set(same)):
            return []
        return (ordered_windows if spec.order == "entered" else compact_windows)(places, same, spec.span)
    if spec.mode == "exact":
        return [[(0, s, e)] for s, e in places[same[0]]]
    ranges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t, d in enumerate(same):
        for s, e in places[d]:
            ranges.setdefault((s, e), []).append((t, s, e))
    return [ranges[k] for k in sorted(ranges)]


def ignored_runs() -> re.Pattern:
    """Runs of what a search ignores, as a pattern: punctuation, separators, white space, zero-width."""
    import sys
    import unicodedata

    zero = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x85, *range(0x09, 0x0E)}
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in "PZ" or code in zero:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


def without_ignored(body: str, ignored: re.Pattern) -> tuple[str, list[int], list[int]]:
    """The searchable stream, and its offset map in runs: from stream position starts[i] on, the body's
    position is shifts[i] further."""
    kept, starts, shifts, at, length = [], [], [], 0, 0
    for m in ignored.finditer(body):
        if m.start() > at:
            kept.append(body[at : m.start()])
            starts.append(length)
            shifts.append(at - length)
            length += m.start() - at
        at = m.end()
    if at < len(body):
        kept.append(body[at:])
        starts.append(length)
        shifts.append(at - length)
    return "".join(kept), starts, shifts


_HITS = (
    "doc_id bigint, search_start int, search_end int, original_start int, original_end int, matched string,"
    " left_context string, right_context string, left_neighbours string, right_neighbours string, term_matches array<struct<term_index: int, search_start: int, search_end: int>>"
)

_HIT_NAMES = ["doc_id", "search_start", "search_end", "original_start", "original_end", "matched", "left_context", "right_context", "left_neighbours", "right_neighbours", "term_matches"]


def find_hits(documents: DataFrame, spec: SearchSpec, id_column: str = "doc_id", body_column: str = "body") -> DataFrame:
    """Hits with search and original offsets, the matched original text, context and five neighbours.

    Null and empty bodies have no hits. The prefilter runs JVM-side on the normalised stream, so only
    documents with hits reach Python; texts are scanned whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ignored = ignored_runs()
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"], batch["body"]):
                if spec.punctuation == "ignore":
                    stream, starts, shifts = without_ignored(body, ignored)
                    original = lambda at: at + shifts[bisect_right(starts, at) - 1]  # noqa: E731, B023
                else:
                    stream, original = body, lambda at: at
                for chosen in match_text(spec, stream):
                    s, e = min(x[1] for x in chosen), max(x[2] for x in chosen)
                    a, b = original(s), original(e - 1) + 1
                    out.append(
                        (doc, s, e, a, b, body[a:b], body[max(0, a - spec.context) : a], body[b : b + spec.context], stream[max(0, s - 5) : s], stream[e : e + 5])
                        + ([{"term_index": t, "search_start": x, "search_end": y} for t, x, y in chosen],)
                    )
            yield pd.DataFrame(out, columns=_HIT_NAMES)

    documents = documents.select(F.col(id_column).alias("doc_id"), F.col(body_column).alias("body")).where("body is not null and body <> ''")
    return documents.where(prefilter(spec, normalised(F.col("body"), spec.punctuation))).mapInPandas(run, _HITS)


def collapse_match(matched: Column, after: int = 260, kept: int = 80) -> Column:
    """A long match shown by its ends."""
    return F.when(F.length(matched) > after, F.concat(F.substring(matched, 1, kept), F.lit("……"), F.right(matched, F.lit(kept)))).otherwise(matched)


def occurrence_key(*columns: str) -> Column:
    return F.concat_ws(":", *columns)


def first_per_body(documents: DataFrame, fingerprint: str, order: str) -> DataFrame:
    """The first document of each body in manifest order; documents of empty fingerprint all stay. Combined
    map-side, so a page copied a billion times is one row a task."""
    blank = F.coalesce(F.col(fingerprint), F.lit("")) == ""
    whole = F.struct(*[F.col(c) for c in documents.columns])
    first = documents.where(~blank).groupBy(F.col(fingerprint).alias("_body")).agg(F.min_by(whole, F.struct(F.col(order).isNull(), F.col(order))).alias("_first"))
    return first.select("_first.*").unionByName(documents.where(blank))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Hits without those that say the same: one per document, original and searchable range."""
    return hits.dropDuplicates(["doc_id", "original_start", "original_end", "search_start", "search_end"])


HIT_ORDER = ("path", "original_start", "original_end")


def present(hits: DataFrame, context: int) -> DataFrame:
    """Hits with their stored context cut to what was asked for and long matches shown by their ends."""
    width = F.lit(min(max(context, 0), STORED_CONTEXT))
    return hits.withColumns({"left_context": F.right("left_context", width), "right_context": F.left("right_context", width), "shown": collapse_match(F.col("matched"))})


def result_page(manifest: DataFrame, spec: SearchSpec, most_hits: int | None = 1000, most_documents: int | None = 1000) -> DataFrame:
    """One page of a search as a reader sees it: hits in the order of path and place, without repetitions,
    presented; beside each the totals of the search and whether it is complete.

    manifest: doc_id, path, body and what the scope asks for. An interactive search has a budget: the first
    ``most_documents`` documents of the scope by path are searched, and the first ``most_hits`` hits in them
    count; it is complete if neither bound cut anything. Without bounds (None) the whole scope is searched.
    spec.deduplicate keeps the first document of each exact body. A page without hits has no rows.
    """
    scope = in_scope(manifest, spec)
    if spec.deduplicate:
        scope = first_per_body(scope.withColumn("_print", F.sha2("body", 256)), "_print", "path").drop("_print")
    wide = SearchSpec.from_dict({**spec.to_dict(), "context": max(spec.context, STORED_CONTEXT)})
    chosen = scope if most_documents is None else scope.orderBy("path", "doc_id").limit(most_documents)
    hits = distinct_hits(find_hits(chosen, wide)).join(chosen.select("doc_id", "path"), "doc_id")
    cut_documents = F.lit(False) if most_documents is None else scope.agg((F.count("*") > most_documents).alias("x")).scalar()
    order = [F.col(c) for c in (*HIT_ORDER, "doc_id")]
    counted = hits.agg(F.count("*").alias("n"))
    kept = hits if most_hits is None else hits.orderBy(*order).limit(most_hits)
    rows = page_of(kept, order, spec.page, spec.per_page)
    total = F.col("_n") if most_hits is None else F.least("_n", F.lit(most_hits))
    complete = ~cut_documents if most_hits is None else ~cut_documents & (F.col("_n") < most_hits)
    shown = present(rows, spec.context).withColumn("_n", counted.scalar())
    return shown.withColumns({"total": total, "total_pages": F.greatest(F.ceil(total / spec.per_page), F.lit(1)), "complete": complete, "truncated": ~complete}).drop("_n")


def page_of(rows: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page of sorted rows. Only the rows up to the page's end are kept while sorting (a top-k), and
    the running number is taken over those."""
    page, per_page = max(1, page), min(max(1, per_page), 50)
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def hit_counts(scope: DataFrame, hits: DataFrame) -> DataFrame:
    """Every document in scope with its number of hits, documents without hits too."""
    counts = hits.groupBy("doc_id").agg(F.count("*").alias("occurrences"))
    return scope.join(counts, "doc_id", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def neighbours(hits: DataFrame) -> DataFrame:
    """side, distance, character, occurrences, documents and share of the position, from the five
    characters before and after each hit."""
    left = hits.select("doc_id", F.lit("L").alias("side"), F.posexplode(F.split(F.reverse("left_neighbours"), "")).alias("at", "ch"))
    right = hits.select("doc_id", F.lit("R").alias("side"), F.posexplode(F.split("right_neighbours", "")).alias("at", "ch"))
    counted = left.unionByName(right).where("ch <> ''").groupBy("side", (F.col("at") + 1).alias("distance"), "ch").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("documents"))
    return counted.withColumn("share", F.col("occurrences") / F.sum("occurrences").over(Window.partitionBy("side", "distance")))
