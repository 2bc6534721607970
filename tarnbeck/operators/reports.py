"""Checks of reports and answers: every rule is a condition that yields error rows, never an exception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.operators.aggregates import SEVERITIES, score_band
from tarnbeck.sources.folders import stored

# What a report's fields may hold, and its limits.
CATEGORIES = [f"SC{k:02d}" for k in range(1, 11)]
MODES = ["quick", "standard", "pro"]
COMPLETENESS = ["complete", "partial", "failed"]
MOST_EVIDENCE = 5


def id_set_errors(got: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: whether the lengths differ, and how many ids are repeated, unknown and missing."""
    g = got.groupBy(key).agg(F.count("*").alias("n"))
    both = g.join(expected.groupBy(key).agg(F.count("*").alias("m")), key, "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return both.agg(
        (F.coalesce(F.sum(n), F.lit(0)) != F.coalesce(F.sum(m), F.lit(0))).alias("length_differs"), F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).alias("duplicates"),
        F.count(F.when(m == 0, 1)).alias("unknown"), F.coalesce(F.sum(F.when(n == 0, m)), F.lit(0)).alias("missing"),
    )


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each rule whose condition is false. A null condition passes, as a CHECK does."""
    names = F.array_compact(F.array(*[F.when(~condition, F.lit(name)) for name, condition in rules.items()]))
    return df.select(key.alias("key"), F.explode(names).alias("rule"))


def report_errors(reports: DataFrame, findings: DataFrame, coverage: DataFrame, partial_rule: bool = True, forced_partial: bool = False) -> DataFrame:
    """(report, key, rule): every rule that a report breaks; key is the finding's id where the rule is about a finding.

    ``reports``: (report, mode, completeness, score, score_status, band, summary, notes, gas), of which summary is a text and
    notes and gas count entries. ``findings``: (report, id, stable_key, want_id, want_key, category, severity, status, patch,
    evidence, locations), the last two counts. ``coverage``: (report, category, status).

    R-02 key and id are those computed; R-04 a finding's category is DETECTED; R-05 a partial or failed report has a
    NOT_ASSESSED category (``partial_rule=False`` leaves this rule out; ``forced_partial`` lets a partial report pass whose ten
    categories are all DETECTED and backed by a finding that isn't informational); R-06 quick reports have neither patch nor gas
    entries; R-07 status and severity are informational together; R-08 a score is there just when it was computed, with its
    own band; R-09 summary and notes are for pro; then the shapes: ten distinct categories, ids once each, fields from their
    lists, at most MOST_EVIDENCE lines of evidence, a location or more. A null field breaks the rule that needs it."""
    said = lambda c: F.coalesce(c, F.lit(False))
    plain = F.col("severity") != "INFORMATIONAL"
    # several rows of a category are one first, so that a report's own row holds ten categories at most; sizes guessed from the
    # reports' files miss that a report has many rows, so nothing here is broadcast by them
    each_category = coverage.groupBy("report", "category").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "NOT_ASSESSED").alias("gap"), F.bool_or(F.col("status") == "DETECTED").alias("some"), F.bool_and(F.col("status") == "DETECTED").alias("all"))
    listed = F.col("category").isin(CATEGORIES)
    covered = each_category.groupBy("report").agg(
        F.sum("n").alias("n"), F.count("category").alias("kinds"), F.bool_and(said(listed)).alias("known"), F.bool_or("gap").alias("gap"),
        F.count(F.when(F.col("some"), F.col("category"))).alias("detected"), F.collect_list(F.when(F.col("all") & listed, F.col("category"))).alias("hits"),
    ).hint("merge")
    backed = findings.filter(plain & F.col("category").isin(CATEGORIES)).groupBy("report").agg(F.count_distinct("category").alias("backed")).hint("merge")
    r = reports.join(covered, "report", "left").join(backed, "report", "left")
    partial = F.col("completeness").isin("partial", "failed") & ~said(F.col("gap"))
    if forced_partial:
        partial &= ~said((F.col("completeness") == "partial") & (F.col("detected") == len(CATEGORIES)) & (F.col("backed") == len(CATEGORIES)))
    scored = F.col("score_status") == "computed"
    whole = {
        "R-05": ~partial if partial_rule else F.lit(True), "R-06": (F.col("mode") != "quick") | (F.col("gas") == 0),
        "R-08": said(scored == F.col("score").isNotNull()) & (~said(scored) | said(F.col("band") == score_band(F.col("score")))),
        "R-09": (F.col("mode") == "pro") | (F.col("summary").isNull() & (F.col("notes") == 0)), "categories": (F.col("n") == len(CATEGORIES)) & (F.col("kinds") == len(CATEGORIES)) & F.col("known"),
        "mode": F.col("mode").isin(MODES), "completeness": F.col("completeness").isin(COMPLETENESS),
    }
    f = findings.join(covered.select("report", "hits").hint("merge"), "report", "left").join(reports.select("report", "mode").hint("merge"), "report", "left")
    f = f.withColumn("is_detected", F.array_contains("hits", F.col("category")))
    each = {
        "R-02": (F.col("stable_key") == F.col("want_key")) & (F.col("id") == F.col("want_id")), "R-04": ~F.col("category").isin(CATEGORIES) | F.col("is_detected"),
        "R-06": (F.col("mode") != "quick") | F.col("patch").isNull(), "R-07": (F.col("status") == "informational") == (F.col("severity") == "INFORMATIONAL"),
        "severity": F.col("severity").isin(SEVERITIES), "evidence": F.col("evidence") <= MOST_EVIDENCE, "locations": F.col("locations") >= 1,
    }
    broken = lambda df, key, rules: df.select("report", key.alias("key"), F.explode(F.array_compact(F.array(*[F.when(~said(ok), F.lit(n)) for n, ok in rules.items()]))).alias("rule"))
    twice = findings.groupBy("report", "id").agg(F.count("*").alias("n")).filter("n > 1").select("report", F.col("id").alias("key"), F.lit("repeated_id").alias("rule"))
    return broken(r, F.lit(None).cast("string"), whole).unionByName(broken(f, F.col("id"), each)).unionByName(twice)


def repeated(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that a unique rule finds more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.concat_ws(":", *keys).alias("key"), F.lit(rule).alias("rule"))


def first_failure(rules: Sequence[tuple[str, Column]], passed: str = "ok") -> Column:
    """The first rule, in order, whose condition holds."""
    out = F.when(rules[0][1], rules[0][0])
    for name, condition in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(passed)


def in_scope(locations: DataFrame, primary: DataFrame, context: DataFrame, excluded: DataFrame, file_col: str) -> DataFrame:
    """Each location with its file's kind; one in no list is unknown."""
    kinds = [d.select(file_col, F.lit(k).alias("kind"), F.lit(n).alias("rank")) for n, (k, d) in enumerate([("primary", primary), ("context", context), ("excluded", excluded)])]
    best = kinds[0].union(kinds[1]).union(kinds[2]).groupBy(file_col).agg(F.min_by("kind", "rank").alias("kind"))
    return locations.join(best, file_col, "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def discarded(locations: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """(key, kept): a finding goes whole if any of its locations lies outside the allowed kinds."""
    return locations.groupBy(key).agg(F.bool_and(F.col("kind").isin(*allowed)).alias("kept"))


def merged(drafts: DataFrame, identity: Column, order: Sequence[Column]) -> DataFrame:
    """Without exact repetitions: of each identity the first row in order."""
    w = Window.partitionBy("_identity").orderBy(*order)
    return drafts.withColumn("_identity", identity).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_identity", "_n")


def gate(new: DataFrame, severity: str, confidence: str, category: str, severities: Sequence[str], least: str, categories: Sequence[str], scale: Sequence[str] = ("low", "medium", "high")) -> Column:
    """Whether a new finding blocks: severity and category in the lists, confidence at the least or missing or unknown."""
    rank = F.array_position(F.array(*map(F.lit, scale)), F.col(confidence))
    sure = F.coalesce(rank == 0, F.lit(True)) | (rank >= list(scale).index(least) + 1)
    return F.col(severity).isin(*severities) & sure & F.col(category).isin(*categories)


def advisory(status: Column, flags: Sequence[str], oks: Sequence[str]) -> Column:
    return F.when(status.isin(*flags), "FLAG").when(status.isin(*oks), "OK").otherwise("NOT_ASSESSED")


def advisory_overall(marks: DataFrame, key: str, mark: str) -> DataFrame:
    """FAIL with any FLAG, INCOMPLETE with nothing but NOT_ASSESSED, else PASS."""
    flag, ok = F.bool_or(F.col(mark) == "FLAG"), F.bool_or(F.col(mark) == "OK")
    return marks.groupBy(key).agg(F.when(flag, "FAIL").when(ok, "PASS").otherwise("INCOMPLETE").alias("overall"))


def final_verdict(verdict: Column, evidence: Column) -> Column:
    """SUPPORTED and CONTRADICTED hold only if there is evidence and all of it is verified."""
    sure = (F.size(evidence) > 0) & F.forall(evidence, lambda e: e == "verified")
    return F.when(verdict.isin("SUPPORTED", "CONTRADICTED") & ~sure, "UNVERIFIABLE").otherwise(verdict)


def plain_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Words of a shingle by which long quotes are looked up, and characters of a gram for those that are too short for it.
SHINGLE, GRAM = 2, 3


def _kind(text: Column) -> Column:
    """By what a quote is looked up: 0 shingles, which its first and last word have no part in, for they may be cut; 1 to GRAM:
    grams of as many characters."""
    return F.when(F.size(F.split(text, " ")) >= SHINGLE + 2, 0).otherwise(F.least(F.length(text), F.lit(GRAM)))


def _grams(text: Column, kind: Column, inner: int) -> Column:
    """The distinct grams of a text. Of shingles, ``inner`` words are left out at either end."""
    words = F.split(text, " ")
    at = lambda first, last: F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    shingles = F.transform(at(F.lit(1 + inner), F.size(words) - inner - SHINGLE + 1), lambda k: F.array_join(F.slice(words, k, SHINGLE), " "))
    grams = F.transform(at(F.lit(1), F.length(text) - kind + 1), lambda k: F.substring(text, k, kind))
    return F.array_distinct(F.when(kind == 0, shingles).otherwise(grams))


def evidence_status(quotes: DataFrame, lines: DataFrame, key: str, near: int = 3, end: str | None = None) -> DataFrame:
    """Of each quote (key, file, line, quote): verified if a line of the file within ``near`` of the stated one holds it,
    location_mismatch if another one does, fabricated if none does, unverifiable if the file is not there or no line is
    stated. Runs of white space count as one. With a column ``end`` the stated place reaches from ``line`` to ``end``.

    Quotes meet lines by an index and not by their file: a line's word shingles, of which each quote asks for the rarest, or
    for short quotes its grams of characters. What is met is verified. Equal lines of a file are one text, equal quotes of a file one
    quote; the nearest of a text's lines is found in their order."""
    q = stored(quotes.select(key, "file", "line", F.col(end or "line").alias("end"), plain_spaces(F.col("quote")).alias("q")), "quotes")
    asked = q.filter("q <> '' AND file IS NOT NULL").select("file", "q").distinct().withColumn("kind", _kind(F.col("q")))
    asked = stored(asked.withColumn("quote_id", F.monotonically_increasing_id()), "quotes")
    wanted = stored(asked.select("quote_id", "file", "kind", F.explode(_grams(F.col("q"), F.col("kind"), 1)).alias("gram")), "wanted")

    own = lines.select("file", "line", plain_spaces(F.col("text")).alias("text")).join(asked.select("file").distinct(), "file", "left_semi").filter("text <> ''")
    texts = stored(own.select("file", "text").distinct().withColumn("text_id", F.monotonically_increasing_id()), "texts")
    kinds = asked.select("file", "kind").distinct()
    held = texts.join(kinds, "file").select("text_id", "file", "kind", F.explode(_grams(F.col("text"), F.col("kind"), 0)).alias("gram"))
    held = stored(held.join(wanted.select("file", "kind", "gram").distinct(), ["file", "kind", "gram"], "left_semi"), "held")
    counts = stored(held.groupBy("file", "kind", "gram").agg(F.count("*").alias("n")), "counts")
    rare = wanted.join(counts, ["file", "kind", "gram"], "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "file", "kind", "gram")).alias("x"))
    # a gram that no line has settles its quote
    rare = stored(rare.filter("x.n > 0").select("quote_id", "x.file", "x.kind", "x.gram"), "rarest")
    met = rare.join(held, ["file", "kind", "gram"]).select("quote_id", "text_id")
    met = met.join(asked.select("quote_id", "q"), "quote_id").join(texts.select("text_id", "text"), "text_id").filter(F.col("text").contains(F.col("q")))
    met = stored(met.select("quote_id", "text_id"), "met")

    lines_of = own.join(texts, ["file", "text"]).select("text_id", F.col("line").alias("at"), F.lit(None).cast(q.schema[key].dataType).alias(key), F.lit(None).cast("long").alias("line"), F.lit(False).alias("asks"))
    places = q.join(asked, ["file", "q"]).join(met, "quote_id").select("text_id", F.col("end").alias("at"), key, "line", F.lit(True).alias("asks"))
    both = lines_of.unionByName(places)
    line = F.when(~F.col("asks"), F.col("at"))
    up, down = (Window.partitionBy("text_id").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((F.asc("at"), F.asc("asks")), (F.desc("at"), F.asc("asks"))))
    before, after = F.last(line, ignorenulls=True).over(up), F.last(line, ignorenulls=True).over(down)
    above = F.when(F.col("_before").isNotNull(), F.greatest(F.col("line") - F.col("_before"), F.lit(0)))
    gaps = both.withColumns({"_before": before, "_after": after}).filter("asks")
    gaps = gaps.groupBy(key).agg(F.min(F.least(above, F.col("_after") - F.col("at"))).alias("_gap"))
    files = lines.join(q.select("file").distinct(), "file", "left_semi").select("file").distinct().withColumn("_there", F.lit(True))
    out = q.join(files, "file", "left").join(gaps, key, "left")
    status = F.when(F.col("_there").isNull() | F.col("q").isNull() | (F.col("q") == "") | F.col("line").isNull(), "unverifiable").when(F.col("_gap").isNull(), "fabricated").when(F.col("_gap") <= near, "verified").otherwise("location_mismatch")
    return out.select(key, status.alias("status"))


def finding_evidence(findings: DataFrame, quotes: DataFrame, locations: DataFrame, lines: DataFrame, key: str, near: int = 3) -> DataFrame:
    """(key, status) of each finding by all its quotes (key, quote) and locations (key, file, line, end). A quote is verified near any
    of the locations, mismatched if one of their files holds it elsewhere, fabricated if none does, unverifiable if none of the
    files is there. Of a finding, fabricated outranks location_mismatch, that unverifiable, that verified; one without
    quotes or locations is unverifiable."""
    rows = quotes.select(key, "quote").distinct().join(locations.select(key, "file", "line", "end").distinct(), key)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "evidence")
    found = rows.join(evidence_status(rows, lines, "_row", near, "end"), "_row")
    has = lambda status: F.bool_or(F.col("status") == status)
    each = found.groupBy(key, "quote").agg(F.when(has("verified"), 1).when(has("location_mismatch"), 3).when(has("fabricated"), 4).otherwise(2).alias("_s"))
    worst = each.groupBy(key).agg(F.max("_s").alias("_s"))
    names = F.create_map(*[F.lit(x) for pair in ((1, "verified"), (2, "unverifiable"), (3, "location_mismatch"), (4, "fabricated")) for x in pair])
    return findings.select(key).distinct().join(worst, key, "left").select(key, names[F.coalesce("_s", F.lit(2))].alias("status"))


def bytecode_verdict(verified: Column, source: Column, runtime: Column, unlinked: Column, unresolved: Column) -> Column:
    """UNRESOLVED, UNAVAILABLE, INCOMPLETE, MATCH or MISMATCH, the first that applies."""
    missing = ~F.coalesce(verified, F.lit(False)) | source.isNull() | runtime.isNull()
    return F.when(F.coalesce(unresolved, F.lit(False)), "UNRESOLVED").when(missing, "UNAVAILABLE").when(F.coalesce(unlinked, F.lit(False)), "INCOMPLETE").when(source == runtime, "MATCH").otherwise("MISMATCH")
