"""Scalar functions as Column expressions, all on the JVM. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_email(c: Column) -> Column:
    """Trimmed and lower-cased; null if it has no local part, domain or dot in it, or over 254 characters."""
    x = F.lower(F.trim(c))
    return F.when(x.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length(x) <= 254), x)


def email_domain(c: Column) -> Column:
    """What follows the last @, without dots at its ends."""
    return F.regexp_replace(F.lower(F.substring_index(c, "@", -1)), r"^\.+|\.+$", "")


def domain_suffixes(domain: Column) -> Column:
    """Every dotted suffix with two labels at least."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(n >= 2, every).otherwise(F.array().cast("array<string>"))


def normalised_path(c: Column) -> Column:
    r"""Backslashes as slashes, leading ./ taken off."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def file_stem(c: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(c, r"([^/]*)$", 1), r"^(.+?)(\.[^.]*)?$", 1)


def extension(c: Column) -> Column:
    """Lower-case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(c, r"([^/]*)$", 1), r"[^.](\.[^./]+)$", 1))


def path_error(c: Column, longest: int = 400, deepest: int = 32) -> Column:
    """The first rule that a path breaks, or null."""
    parts = F.split(c, "/")
    return (
        F.when(c.isNull() | (F.length(c) == 0), "empty").when(F.length(c) > longest, "too_long").when(c.rlike(r"[\x00-\x1F\x7F]"), "control_character")
        .when(F.contains(c, F.lit("\\")), "backslash").when(c.startswith("/") | c.rlike(r"^[A-Za-z]:"), "absolute").when(F.size(parts) > deepest, "too_deep")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "bad_segment")
    )


#: What kind of file a name makes.
SOURCES = [".sol", ".vy", ".rs", ".move", ".cairo"]
DOCUMENTS = [".md", ".txt", ".rst"]
IGNORED_DIRS = ["node_modules", ".git", "lib", "out", "artifacts", "cache"]


def path_kind(c: Column) -> Column:
    """source, document or ignored, by folder and extension."""
    parts = F.split(F.lower(c), "/")
    ext = extension(c)
    return F.when(F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS))), "ignored").when(ext.isin(*SOURCES), "source").when(ext.isin(*DOCUMENTS), "document").otherwise("ignored")


def line_feeds(c: Column) -> Column:
    """Without a byte order mark, all line ends as \\n."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")


def decoded(c: Column) -> Column:
    """Bytes as text, null where they are not UTF-8, line ends as \\n."""
    return line_feeds(F.try_validate_utf8(c.cast("string")))


def workspace_key(category: Column, workspace: Column, name: Column) -> Column:
    """category/workspace/name, null unless each part is plain."""
    ok = lambda x: x.rlike(r"^[A-Za-z0-9_-]{1,128}$")
    return F.when(ok(category) & ok(workspace) & ok(name), F.concat_ws("/", category, workspace, name))


def scoped_key(workspace: Column, key: Column) -> Column:
    return F.concat(workspace, F.lit(":"), key)


def without_query(c: Column) -> Column:
    return F.regexp_replace(c, r"\?.*$", "")


def masked_keys(c: Column, prefix: str) -> Column:
    """API keys prefix_x_y as prefix_***."""
    return F.regexp_replace(c, rf"{prefix}_[A-Za-z0-9]+_[A-Za-z0-9]+", f"{prefix}_***")


def fingerprint(**parts: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys, null fields kept."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, null as empty (concat_ws would leave it out)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def git_blob_sha(c: Column) -> Column:
    """SHA-1 of a text as a blob object: its byte length goes before."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(c).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def parsed_time(c: Column) -> Column:
    """ISO time or null; without a zone it is UTC (the session's)."""
    return F.try_to_timestamp(c)


def retry_after(remaining_seconds: Column, window: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(window), F.ceil(remaining_seconds))).cast("long")


def backoff_seconds(attempt: Column, base: int = 5, most: int = 60) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(30))), F.lit(most)).cast("long")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds)


def kept_if_null(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def service_month(anchor: Column, at: Column) -> Column:
    """(start, end): the month from the anchor, days clamped to the month's length, that holds ``at``; before the anchor
    the first. Months are counted from the anchor itself, so a clamped day comes back."""
    step = lambda k: anchor + F.make_ym_interval(F.lit(0), k)
    k = (F.year(at) - F.year(anchor)) * 12 + F.month(at) - F.month(anchor)
    k = F.when(step(k.cast("int")) > at, k - 1).otherwise(k)
    k = F.greatest(k, F.lit(0)).cast("int")
    return F.struct(step(k).alias("start"), step(k + 1).alias("end"))


def first_item(json: Column, field: str) -> Column:
    """A field of a document's first item, else of the document; an id may be a string or an object that holds it."""
    path = lambda p: F.get_json_object(json, p)
    own = F.coalesce(path(f"$.items.data[0].{field}"), path(f"$.{field}"))
    return F.when(own.startswith("{"), F.get_json_object(own, "$.id")).otherwise(own)


def language(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("en"))


def version_parts(c: Column) -> Column:
    """A three-part version as an array of integers, which compares by number; null for anything else."""
    return F.when(c.rlike(r"^\d+\.\d+\.\d+$"), F.transform(F.split(c, r"\."), lambda x: x.cast("int")))


def array_length(type_: Column) -> Column:
    """N of a type T[N], else null."""
    return F.nullif(F.regexp_extract(type_, r"\[(\d+)\]$", 1), F.lit("")).cast("int")


def normalised_hex(c: Column) -> Column:
    """Lower-case digits without 0x; null for an odd length or another character."""
    x = F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    return F.when(x.rlike("^([0-9a-f]{2})*$"), x)


def without_metadata(code: Column) -> Column:
    """Bytecode less its trailing metadata: the last two bytes are its length, and it starts with a map."""
    n = F.length(code)
    size = F.conv(F.substring(code, -4, 4), 16, 10).cast("int") * 2
    head = F.substr(code, n - 4 - size + 1, F.lit(2))
    fits = (n >= 4) & (size > 0) & (size + 4 <= n)
    return F.when(fits & head.between("a0", "b7"), F.left(code, n - 4 - size)).otherwise(code)


def elided(c: Column, head: int, tail: int) -> Column:
    """At most head + tail characters, the middle left out."""
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("…"), F.right(c, F.lit(tail))))


def minimal_proxy_target(code: Column) -> Column:
    """The address in the 45-byte minimal proxy, else null."""
    return F.nullif(F.regexp_extract(code, "^363d3d373d3d3d363d73([0-9a-f]{40})5af43d82803e903d91602b57fd5bf3$", 1), F.lit(""))


def deadline_share(remaining: Column, left: Column, weight: Column, weights: Column, least: int = 30) -> Column:
    """Seconds of a pass: a base of ``least`` at most, and a part of the rest by weight."""
    base = F.least(F.lit(float(least)), remaining / left)
    return base + (remaining - base * left) * weight / weights


def selection_trigger(blocking: Column, size: Column, budget: Column) -> Column:
    return F.when(blocking, "blocking_reason").when(size > budget, "over_budget")
