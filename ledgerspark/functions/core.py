"""Column functions that the reports share. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity (-2.5 -> -2), unlike round()."""
    k = F.lit(float(10**digits))
    return F.floor(x * k + F.lit(0.5)) / k


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: an emoji counts two."""
    return (F.length(F.encode(s, "UTF-16LE")) / 2).cast("long")


def approx_tokens(s: Column) -> Column:
    """A quarter of the text's length, rounded up."""
    return F.ceil(utf16_length(F.coalesce(s, F.lit(""))) / 4)


def percent_change(now: Column, base: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise((now - base) / base * 100)


def ratio_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, round_half_up(part / whole * 100, digits)).otherwise(F.lit(0.0))


def median_of(values: Column) -> Column:
    """Median of an array: mean of the middle two, 0 for none."""
    s, n = F.array_sort(values), F.size(values)
    lo = F.try_element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    hi = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2).otherwise(F.lit(0.0))


def upper_median(x: Column) -> Column:
    """Aggregate: the upper of the middle two; null for none."""
    s = F.array_sort(F.collect_list(x))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def version_parts(v: Column) -> Column:
    """First three numeric parts; arrays compare part by part."""
    p = F.split(F.coalesce(v, F.lit("")), r"[.-]")
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("int"), F.regexp_extract(F.coalesce(F.try_element_at(p, F.lit(i)), F.lit("")), r"^\d+", 0).try_cast("int"), F.lit(0))
    return F.array(part(1), part(2), part(3))


def version_in_range(v: Column, first: Column, last: Column) -> Column:
    p = version_parts(v)
    return (p >= version_parts(first)) & (p <= version_parts(last))


def release_of(v: Column) -> Column:
    """A pre-release counts as its release."""
    return F.regexp_replace(v, r"-.*", "")


def folder_hash(cwd: Column) -> Column:
    """A path as a folder name: everything but letters and digits becomes a dash."""
    return F.regexp_replace(cwd, r"[^A-Za-z0-9]", "-")


def last_segment(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path, r"[\\/]+"), lambda x: x != ""), F.lit(-1))


def project_name(cwd: Column, project_hash: Column) -> Column:
    own = F.try_element_at(F.filter(F.split(project_hash, "-"), lambda x: x != ""), F.lit(-1))
    return F.coalesce(F.when(F.length(cwd) > 0, last_segment(cwd)), own, project_hash)


def short_session_id(session_id: Column, time_ordered: Column) -> Column:
    """8 characters; 18 for time-ordered ids, whose first ones are a clock."""
    uuid7 = session_id.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-")
    return F.when(time_ordered & uuid7, F.substring(session_id, 1, 18)).otherwise(F.substring(session_id, 1, 8))


def safe_session_id(session_id: Column) -> Column:
    """Ids that may name a file; others are null."""
    return F.when(session_id.rlike(r"^[A-Za-z0-9_-]{1,128}$"), session_id)


def normal_path(path: Column) -> Column:
    """Forward slashes, lower-case drive letter, no empty, . and .. parts."""
    p = F.regexp_replace(path, r"\\", "/")
    drive = F.regexp_extract(p, r"^([A-Za-z]):", 1)
    p = F.when(drive != "", F.concat(F.lower(drive), F.substring(p, 2, 2**31 - 1))).otherwise(p)
    rooted = p.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        back = F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).when(rooted, acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
        return F.when((part == "") | (part == "."), acc).when(part == "..", back).otherwise(F.concat(acc, F.array(part)))

    parts = F.array_join(F.aggregate(F.split(p, "/"), empty, step), "/")
    joined = F.when(rooted, F.concat(F.lit("/"), parts)).otherwise(F.when(parts == "", F.lit(".")).otherwise(parts))
    return F.when(F.length(path) == 0, F.lit("")).otherwise(joined)


def within_folder(inner: Column, outer: Column) -> Column:
    """inner is outer or below it; Windows paths compare without case."""
    a, b = normal_path(inner), F.rtrim(normal_path(outer), F.lit("/"))
    windows = a.rlike(r"^[A-Za-z]:")
    a, b = F.when(windows, F.lower(a)).otherwise(a), F.when(windows, F.lower(b)).otherwise(b)
    return (a == b) | a.startswith(F.concat(b, F.lit("/")))


def human_duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s.cast("long"))).otherwise(F.format_string("%ds", s.cast("long")))


def window_label(minutes: Column) -> Column:
    """Weekly, N-day or N-hour."""
    hours = round_half_up(minutes / 60, 1)
    shown = F.when(hours == F.floor(hours), F.floor(hours).cast("string")).otherwise(hours.cast("string"))
    return (
        F.when(minutes == 10080, F.lit("Weekly"))
        .when(minutes % 1440 == 0, F.concat((minutes / 1440).cast("long").cast("string"), F.lit("-day")))
        .otherwise(F.concat(shown, F.lit("-hour")))
    )


def days_since(as_of: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, as_of), F.lit(0))


def days_left_in_month(day: Column) -> Column:
    return F.datediff(F.last_day(day), day)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def days_between(earlier_ms: Column, later_ms: Column) -> Column:
    """Whole days, at least one for any positive span, else 0."""
    d = (later_ms - earlier_ms) / 86_400_000
    return F.when(d <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(d + 0.5)))


def first_field(v: Column, names: tuple[str, ...]) -> Column:
    """The first of some string fields of a variant that is there."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.try_variant_get(v, f"$.{n}", "string") for n in names])


def tool_subject(v: Column) -> Column:
    """What a tool call is about: a path, else a command, pattern, url or query."""
    return first_field(v, ("file_path", "path", "command", "pattern", "url", "query"))


#: Tools that name a file, and the field of their input that holds it.
PATH_FIELDS = {"Read": "file_path", "Edit": "file_path", "Write": "file_path", "read_file": "path", "edit_file": "path", "write_file": "path"}


def read_path(name: Column, v: Column) -> Column:
    """The path that a call of a reading or editing tool names, in that tool's own field; null for other tools and for empty paths."""
    fields = {}
    for tool, field in PATH_FIELDS.items():
        fields.setdefault(field, []).append(tool)
    path = F.coalesce(*[F.when(name.isin(*tools), F.try_variant_get(v, f"$.{field}", "string")) for field, tools in fields.items()])
    return F.when(F.length(path) > 0, path)


def file_tokens(size_bytes: Column) -> Column:
    return F.ceil(size_bytes / 4)
