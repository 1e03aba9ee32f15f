"""Scalar functions of the fact model as Column builders; no Python runs on executors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fact model.
DYNAMIC, ANY = "<dynamic>", "ANY"
SEVERITIES = ("INFO", "WARNING", "ERROR")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE")
LABEL_METHODS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")
LABEL_ROUTE, LABEL_TOPIC = r"^/[A-Za-z0-9._~!$&'()*+,;=:@%{}\-/]{1,200}$", r"^[A-Za-z0-9][A-Za-z0-9._-]{0,248}$"
#: Error categories by the marks of which one occurs, the first that fits.
ERROR_MARKS = {"timeout": ("timeout",), "connection": ("connect",), "validation": ("valid",), "authorization": ("authoriz", "forbidden"), "throttling": ("throttl", "rate")}
#: Fixed value: how accessors of service addresses are called.
ACCESSOR = r"\.get([A-Z]\w*)ServiceUrl\("
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def _range(start: Column, end: Column) -> Column:
    """start:end, left out where the start is null (concat_ws skips nulls)."""
    return F.when(start.isNotNull(), F.concat_ws(":", start.cast("string"), end.cast("string")))


def finding_id(rule: Column, path: Column, snippet: Column, start: Column | None = None, end: Column | None = None) -> Column:
    text = F.trim(F.regexp_replace(snippet, r"\s+", " "))
    return _short_id(rule, path, *([] if start is None else [_range(start, end)]), text)


def endpoint_id(role: Column, topic: Column, path: Column, start: Column, end: Column) -> Column:
    return _short_id(role, topic, path, _range(start, end))


def relation_id(source_kind: Column, source: Column, relation: Column, target_kind: Column, target: Column, path: Column, line: Column) -> Column:
    """Location takes part only where both path and line are known."""
    located = path.isNotNull() & line.isNotNull()
    return _short_id(source_kind, source, relation, target_kind, target, F.when(located, path), F.when(located, line.cast("string")))


def segments(path: Column) -> Column:
    """Non-empty segments of a path without its query."""
    return F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda x: x != "")


def _is_hole(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def segments_match(a: Column, b: Column) -> Column:
    """Equal length, and every pair equal or one of it a hole."""
    same = F.forall(F.zip_with(a, b, lambda x, y: (x == y) | _is_hole(x) | _is_hole(y)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & same


def _covers(pattern: Column, concrete: Column) -> Column:
    """pattern ends in ``**`` and concrete is strictly longer than what stands before it, and matches that."""
    n = F.size(pattern) - 1
    wild = (n >= 0) & (F.get(pattern, n) == "**") & (F.size(concrete) > n)
    return F.coalesce(wild & segments_match(F.slice(pattern, F.lit(1), F.greatest(n, F.lit(0))), F.slice(concrete, F.lit(1), F.greatest(n, F.lit(0)))), F.lit(False))


def method_of(topic: Column) -> Column:
    return F.substring_index(topic, " ", 1)


def path_of(topic: Column) -> Column:
    return F.substring(topic, F.instr(topic, " ") + 1, F.length(topic))


def methods_match(a: Column, b: Column) -> Column:
    return (a == b) | (a == ANY) | (b == ANY)


def paths_match(call: Column, serve: Column) -> Column:
    """Whether a called ``METHOD /path`` can be a served one."""
    known = (path_of(call) != DYNAMIC) & (path_of(serve) != DYNAMIC)
    return known & routes_match(method_of(call), segments(path_of(call)), method_of(serve), segments(path_of(serve)))


def routes_match(call_method: Column, call: Column, serve_method: Column, serve: Column) -> Column:
    """Whether a called route can be a served one; both are known."""
    return methods_match(call_method, serve_method) & (F.size(call) > 0) & (segments_match(call, serve) | _covers(call, serve) | _covers(serve, call))


def holes(parts: Column) -> Column:
    """Which segments are holes."""
    return F.transform(parts, _is_hole)


def masked(parts: Column, own: Column, other: Column) -> Column:
    """Segments, with a hole where either of two routes has one: those of two routes are equal if and only if they match."""
    return F.zip_with(parts, F.zip_with(own, other, lambda x, y: x | y), lambda x, hole: F.when(hole, F.lit("{}")).otherwise(x))


def target_hint(snippet: Column, getter: Column | None = None) -> Column:
    """The host that a call names, its first label lowered: a configured getter, else an http host, else a load-balancer name,
    else an api-domain mark."""

    return F.coalesce(*([] if getter is None else [getter]), _label_after(snippet, "https?://"), _label_after(snippet, "lb://"), api_domain(snippet))


def _label_after(text: Column, mark: str) -> Column:
    """The host label right behind a mark, lowered: letters, digits and inner hyphens; null without one."""
    run = F.lower(F.regexp_extract(text, f"(?i){mark}([a-z0-9-]+)", 1))
    return F.when((run != "") & ~run.startswith("-"), F.rtrim(run, F.lit("-")))


def api_domain(snippet: Column) -> Column:
    """The host of a configured client, as its mark names it; null without one."""
    return _label_after(snippet, r"\bapi-domain:")


def external_service(snippet: Column) -> Column:
    """The service outside the workspace that a mark names; null without one."""
    return _label_after(snippet, r"\bexternal-microservice:")


def url_getter(snippet: Column) -> Column:
    """The service of a ``.getOrderItemServiceUrl(`` accessor: order-item-service; null without one."""
    name = F.regexp_extract(snippet, ACCESSOR, 1)
    return F.when(name != "", F.concat(kebab(name), F.lit("-service")))


def alias(name: Column) -> Column:
    """Trimmed, lowered, without trailing dots."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\.+$", "")


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "-"))


def observed(name: Column) -> Column:
    """A runtime name without case, ``-``, ``_`` and ``.``."""
    return F.translate(F.lower(F.trim(name)), "-_.", "")


def containment(a: Column, b: Column) -> Column:
    """Length of the shorter name over that of the longer one where one contains the other, else null."""
    return F.when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def rest_path(raw: Column) -> Column:
    """The path of a URL or path: no scheme, host, query or fragment, single slashes, a leading one."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.regexp_replace(F.concat(F.lit("/"), bare), "/{2,}", "/")


def join_paths(*parts: Column) -> Column:
    pieces = F.filter(F.flatten(F.array(*(segments(p) for p in parts))), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(pieces, "/"))


def strip_prefix(path: Column, n: Column) -> Column:
    parts = segments(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/"))


def plural(word: Column) -> Column:
    return (
        F.when(word.rlike("(?i)[^aeiou]y$"), F.concat(F.regexp_replace(word, "[yY]$", ""), F.lit("ies")))
        .when(word.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def placeholder_key(text: Column) -> Column:
    """The key of ``${key:default}`` or ``#{'${key}'}``, else null."""
    return F.nullif(F.regexp_extract(text, r"\$\{([^}:]+)", 1), F.lit(""))


def placeholder_default(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\$\{[^}:]+:([^}]*)\}", 1), F.lit(""))


def resolved(value: Column, text: Column) -> Column:
    """A looked-up value, else the placeholder's default, else null."""
    return F.coalesce(value, placeholder_default(text))


def topic_name(getter: Column) -> Column:
    """Upper snake case of a camel-case or dashed name."""
    return F.upper(F.translate(F.regexp_replace(F.regexp_replace(getter, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"), "-", "_"))


def parse_duration(text: str) -> int:
    """Seconds of ``15m``, ``1h`` or ``7d``; anything else is an error."""
    m = re.fullmatch(r"([1-9][0-9]*)([smhd])", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * DURATION_UNITS[m[2]]


def duration_seconds(text: Column) -> Column:
    """The same over a column; null where it is none."""
    unit = F.create_map(*(F.lit(x) for pair in DURATION_UNITS.items() for x in pair))
    valid = text.rlike(r"^[1-9][0-9]*[smhd]$")
    return F.when(valid, F.substring_index(F.regexp_replace(text, "([smhd])$", " $1"), " ", 1).cast("long") * F.element_at(unit, F.right(text, F.lit(1))))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null over zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def average_ms(duration_us: Column, calls: Column) -> Column:
    return F.try_divide(duration_us.cast("double"), calls.cast("double") * 1000)


def span_label(method: Column, route: Column, destination: Column, kafka: Column | None = None) -> Column:
    """``METHOD /route`` without query, or the topic of a Kafka span, where they look like such; else null."""
    bare = F.regexp_replace(route, r"[?#].*$", "")
    http = F.upper(method).isin(*LABEL_METHODS) & bare.rlike(LABEL_ROUTE)
    topic = destination.rlike(LABEL_TOPIC) if kafka is None else kafka & destination.rlike(LABEL_TOPIC)
    return F.when(http, F.concat(F.upper(method), F.lit(" "), bare)).when(topic, destination)


def span_origin(kind: Column, subtype: Column, method: Column, messaging: Column, transaction: Column) -> Column:
    """The first that fits of HTTP, Messaging, Kafka, Database, External; else Application."""
    kind, subtype, messaging, transaction = (F.lower(F.coalesce(c, F.lit(""))) for c in (kind, subtype, messaging, transaction))
    return (
        F.when((F.coalesce(method, F.lit("")) != "") | transaction.isin("request", "http"), "HTTP")
        .when(transaction == "messaging", "Messaging")
        .when((messaging == "kafka") | (subtype == "kafka"), "Kafka")
        .when(kind == "messaging", "Messaging")
        .when(kind == "db", "Database")
        .when(kind == "external", "External")
        .otherwise("Application")
    )


def operation_label(value: Column, event: Column, transaction: Column) -> Column:
    """What may be shown of an operation that instrumentation named."""
    low = F.lower(F.coalesce(transaction, F.lit("")))
    shown = F.when(event == "span", "Span").when(low.isin("request", "http"), "HTTP transaction").when(low == "messaging", "Messaging transaction").otherwise("Transaction")
    return F.when(value.isNotNull(), shown)


def span_type(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.isin("request", "http"), "request").when(low.isin("messaging", "db", "external"), low).otherwise("other")


def error_category(text: Column) -> Column:
    """The first category of which a mark occurs, failure for any other text, null without one."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for name, marks in ERROR_MARKS.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | low.contains(mark)
        out = out.when(hit, name)
    return out.otherwise("failure")


def event_kind(event: Column) -> Column:
    return F.when(event == "transaction", "transaction").otherwise("span")


def transaction_kind(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.isin("request", "http"), "HTTP").when(low.contains("messag") | low.contains("kafka"), "messaging").otherwise("other")


def millicores(text: Column) -> Column:
    """``250m`` or ``0.5`` as thousandths of a core, null on errors."""
    milli = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?m$"), F.regexp_replace(text, "m$", "").cast("double"))
    return milli.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.cast("double") * 1000).cast("int")


def memory_bytes(text: Column) -> Column:
    """``128Mi``, ``1.5G`` or a whole number as bytes, null on errors."""
    value = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.regexp_extract(text, r"^[0-9]+(?:\.[0-9]+)?([KMGT]i?|)$", 1)
    powers = {"": 1, **{f"{u}i": 1024 ** (k + 1) for k, u in enumerate("KMGT")}, **{u: 1000 ** (k + 1) for k, u in enumerate("KMGT")}}
    by = F.create_map(*(F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in powers.items() for x in pair))
    return F.when(text.rlike(r"^[0-9]+((\.[0-9]+)?[KMGT]i?)?$"), (value.cast("double") * F.element_at(by, unit)).cast("long"))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def severity_rank(severity: Column) -> Column:
    out = None
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out.otherwise(-1)


def qualified_resource(service: Column, topic: Column) -> Column:
    return F.concat(service, F.lit(": "), topic)


def glob_regex(pattern: str) -> str:
    """An anchored regex of a GLOB in which ``*`` and ``?`` cross ``/``; character classes stay."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(text: Column, pattern: str) -> Column:
    return F.lit(True) & text.isNotNull() if pattern in ("**/*", "**") else text.rlike(glob_regex(pattern))


def is_test_source(path: Column) -> Column:
    """A segment right after ``src`` is ``test`` or ends in ``Test``."""
    parts = F.split(path, "/")
    after = F.transform(parts, lambda x, i: F.when(F.get(parts, i - 1) == "src", (x == "test") | x.endswith("Test")).otherwise(False))
    return F.exists(after, lambda x: F.coalesce(x, F.lit(False)))


def in_git_folder(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), ".git")


def is_excluded_module(path: Column, name: Column) -> Column:
    """Test, mock and archetype modules: by a folder of the path relative to the workspace, or by the declared name; without
    regard to case. The last word is spelled as a fixed value."""
    parts, low = F.split(F.lower(path), "/"), F.lower(F.coalesce(name, F.lit("")))
    return F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | F.lower(path).contains("mock") | low.contains("mock") | low.endswith("-test") | low.contains("archteype")
