"""Facts of Java sources: REST and Kafka endpoints, configured clients, blocking points, entry points, collections.

There is no Java parser here, so a small scanner does: comments are blanked with their line feeds kept, annotations and calls
are read with their balanced parentheses, statements and headers as far as they go, types with their bodies. An expression
is resolved as far as it is made of literals, placeholders and fields that ``@Value`` names; what else joins a path is a hole
``{name}``, and what has no literal at all is dynamic. A file whose braces don't close gives one diagnostic row and no facts.
Each file is handled alone, in Arrow batches, so the stage scales with the number of files.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

_FACT = "path string, fact string, role string, topic string, topic_dynamic boolean, framework string, start_line int, end_line int, snippet string, message_type string"
_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": None}
_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "patchForObject": "PATCH", "delete": "DELETE", "exchange": None}
_BLOCKING = {"sleep": r"\bThread\.sleep\s*\(", "wait": r"\b\w+\.wait\s*\(", "future": r"\b\w*[Ff]uture\w*\.(?:get|join)\s*\(", "lock": r"\b\w*[Ll]ock\w*\.lock\s*\(", "synchronized": r"\bsynchronized\b"}
_STRING = r'"(?:[^"\\\n]|\\.)*"'
#: Fixed values of the project convention: accessors, keys and senders of topics, and the mark that replies carry.
_GETTER, _KEY, _SENDER = r"getTopics\(\)\s*\.\s*get([A-Z]\w*)\s*\(\s*\)", r"\$\{kafka\.topics\.([\w-]+)\.", r"\b(envoyerMessageKafka\w*)\s*\("
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " "}


def blanked(text: str) -> str:
    """The text without comments; literals stay, offsets and lines too."""
    return re.sub(rf"{_STRING}|'(?:[^'\\\n]|\\.)'|//[^\n]*|/\*.*?\*/", lambda m: m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)


def balanced(text: str, at: int, pair: str = "()") -> int:
    """Behind the sign that closes the one at ``at``, or -1 if none does."""
    depth = 0
    for m in re.compile(rf"{_STRING}|'(?:[^'\\\n]|\\.)'|[{re.escape(pair)}]").finditer(text, at):
        depth += {pair[0]: 1, pair[1]: -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return -1


def closed(text: str, at: int) -> int:
    """Behind the closing parenthesis, or the text's end."""
    end = balanced(text, at)
    return len(text) if end < 0 else end


def header_end(text: str, at: int) -> int:
    """Where the declaration at ``at`` has its body or ends: the first ``{`` or ``;`` outside parentheses and literals."""
    depth = 0
    for m in re.compile(rf"{_STRING}|'(?:[^'\\\n]|\\.)'|[(){{;]").finditer(text, at):
        if m[0] in "{;" and not depth:
            return m.start()
        depth += {"(": 1, ")": -1}.get(m[0], 0)
    return len(text)


def masked(text: str) -> str:
    """The text with spaces in place of its literals."""
    return re.sub(rf"{_STRING}|'(?:[^'\\\n]|\\.)'", lambda m: " " * len(m[0]), text)


def statement_start(text: str, at: int) -> int:
    """Where the statement or declaration begins in a masked text."""
    return max(text.rfind(c, 0, at) for c in ";{}") + 1


def unescaped(literal: str) -> str:
    """The value of a string literal's inside."""

    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:].lstrip("u"), 16)) if x[0] == "u" else chr(int(x, 8)) if x[0] in "01234567" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u+[0-9a-fA-F]{4}|[0-3]?[0-7]{1,2}|.)", one, literal, flags=re.DOTALL)


def split(text: str, sign: str) -> list[str]:
    """Parts between signs that stand outside literals and brackets."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(rf"{_STRING}|'(?:[^'\\\n]|\\.)'|[(){{}}\[\]{re.escape(sign)}]", text):
        if m[0] == sign and not depth:
            parts.append(text[at : m.start()])
            at = m.end()
        elif len(m[0]) == 1:
            depth += 1 if m[0] in "({[" else -1 if m[0] in ")}]" else 0
    return [x.strip() for x in [*parts, text[at:]]]


class Expressions:
    """Expressions of one file; fields that ``@Value`` names stand for their placeholder."""

    def __init__(self, text: str) -> None:
        self.mask = masked(text)
        self.fields = {m[2]: unescaped(m[1][1:-1]) for m in re.finditer(rf"@Value\s*\(\s*({_STRING})\s*\)\s*(?:(?:private|protected|public|final|static)\s+)*[\w<>.]+\s+(\w+)", text)}

    def value(self, text: str) -> tuple[str | None, bool]:
        """What an expression is, and whether parts of it are unknown: None if nothing is known."""
        out, unknown = [], False
        for part in split(text, "+"):
            if re.fullmatch(_STRING, part):
                out.append(unescaped(part[1:-1]))
            elif part in self.fields:
                out.append(self.fields[part])
            else:
                unknown = True
                if out:
                    out.append("{" + (part if re.fullmatch(r"\w+", part) else "dynamic") + "}")
        return ("".join(out) or None), unknown

    def values(self, text: str) -> list[tuple[str | None, bool]]:
        """Of an array initialiser each element, else the one value."""
        inner = re.fullmatch(r"\{(.*)\}", text.strip(), re.DOTALL)
        return [self.value(x) for x in split(inner[1], ",") if x] if inner else [self.value(text)]

    def named(self, arguments: str, names: tuple[str, ...]) -> list[tuple[str | None, bool]]:
        """The values of the named attributes, or of the only unnamed one."""
        pairs = [(m[1], x[m.end() :]) if (m := re.match(r"(\w+)\s*=(?!=)\s*", x)) else (None, x) for x in split(arguments, ",") if x]
        given = dict(pairs)
        for name in (*names, None):
            if name in given and (name or len(given) == 1):
                return self.values(given[name])
        return []


def _route(*parts: str) -> str:
    return "/" + "/".join(s for p in parts for s in re.sub(r"[?#].*$", "", re.sub(r"^[a-z]+://[^/]*", "", p)).split("/") if s)


def types_of(text: str, mask: str) -> list[tuple[int, int, int, str, str]]:
    """(begin of annotations, begin of the body, end, kind, name) of every type declared."""
    out = []
    for m in re.finditer(r"\b(class|interface|record|enum)\s+(\w+)", mask):
        body = header_end(text, m.end())
        end = balanced(text, body, "{}") if text[body : body + 1] == "{" else body
        out.append((statement_start(mask, m.start()), body, len(text) if end < 0 else end, m[1], m[2]))
    return out


def facts_of(path: str, source: str) -> Iterator[tuple]:
    text = blanked(source)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    own = Expressions(text)

    def row(fact: str, role: str | None, topic: str | None, framework: str, a: int, b: int, kind: str | None = None, dynamic: bool = False) -> tuple:
        dynamic = dynamic or (topic is not None and (topic.endswith(E.DYNAMIC) or "${" in topic))
        return path, fact, role, topic, dynamic, framework, bisect_right(starts, a), bisect_right(starts, max(a, b - 1)), source[a:b], kind

    if any(own.mask.count(a) != own.mask.count(b) for a, b in ("{}", "()")):
        yield row("diagnostic", None, None, "unparseable", 0, len(text))
        return
    types = types_of(text, own.mask)

    def around(at: int) -> tuple[int, int, int, str, str] | None:
        """The innermost type whose body holds the place."""
        return max((t for t in types if t[1] <= at < t[2]), default=None)

    def head(t: tuple[int, int, int, str, str] | None) -> str:
        return text[t[0] : t[1]] if t else ""

    def called(method: str, value: tuple[str | None, bool], framework: str, a: int, b: int) -> tuple:
        return row("rest", "call", f"{method} {E.DYNAMIC if value[0] is None else _route(value[0])}", framework, a, b, dynamic=value[1])

    for m in re.finditer(r"@(\w+Mapping)\b\s*(\()?", text):
        t = around(m.start())
        if m[1] not in _MAPPINGS or t is None:
            continue
        b = closed(text, m.end() - 1) if m[2] else m.end()
        arguments = text[m.end() : b - 1] if m[2] else ""
        methods = [_MAPPINGS[m[1]]] if _MAPPINGS[m[1]] else re.findall(r"RequestMethod\.(\w+)", arguments) or [E.ANY]
        given = ", ".join(x for x in split(arguments, ",") if not re.match(r"(method|produces|consumes|headers|params|name)\s*=", x))
        routes = own.named(given, ("value", "path")) or ([("", False)] if not given else [])
        base = re.search(r"@RequestMapping\s*\(", head(t))
        prefix = [x for x, _ in own.named(head(t)[base.end() : closed(head(t), base.end() - 1) - 1], ("value", "path")) if x] if base else []
        feign = "@FeignClient" in head(t)
        asked = re.findall(r"@RequestParam\s*(?:\(\s*(?:(?:value|name)\s*=\s*)?\"([^\"]+)\"[^)]*\)|(?:\([^)]*\))?)\s*(?:final\s+)?[\w<>,.\[\]]+\s+(\w+)", text[b : header_end(text, b)])
        query = "?" + "&".join(x or y for x, y in asked) if asked else ""
        for method in methods:
            for p in prefix or [""]:
                for r, unknown in routes or [(None, True)]:
                    yield row("rest", "call" if feign else "serve", f"{method} {E.DYNAMIC}" if r is None else f"{method} {_route(p, r)}{query}", "feign" if feign else "spring-mvc", m.start(), b, dynamic=unknown)
    for m in re.finditer(rf"\b\w*[rR]estTemplate\w*\s*\.\s*({'|'.join(_TEMPLATE)})\s*\(", text):
        b = closed(text, m.end() - 1)
        arguments = split(text[m.end() : b - 1], ",")
        method = _TEMPLATE[m[1]] or (re.findall(r"HttpMethod\.(\w+)", ",".join(arguments)) or [E.ANY])[0]
        yield called(method, own.value(arguments[0]), "resttemplate", m.start(), b)
    last = 0
    for m in re.finditer(r"\.\s*uri\s*\(", text):
        b, begin = closed(text, m.end() - 1), statement_start(own.mask, m.start())
        if verb := re.findall(r"\.\s*(get|post|put|patch|delete|head|options)\s*\(\s*\)", text[begin : m.start()]):
            yield called(verb[-1].upper(), own.value(split(text[m.end() : b - 1], ",")[0]), "webclient", m.start(), b)
        elif target := re.search(r'"(lb://[^"]+)"', text[m.start() : b]):
            for p in re.finditer(r"\.\s*path\s*\(", text[max(begin, last) : m.start()]):
                at = max(begin, last) + p.end() - 1
                for r, _ in (own.value(x) for x in split(text[at + 1 : closed(text, at) - 1], ",")):
                    if r:
                        yield row("rest", "serve", f"{E.ANY} {_route(r)}", "gateway", at, b)
                        yield row("rest", "call", f"{E.ANY} {_route(r)}", f"gateway {target[1]}", at, b)
            last = b
    if "RouterFunction" in text:
        for m in re.finditer(r"(?<![\w.])(?:RequestPredicates\s*\.\s*)?(GET|POST|PUT|PATCH|DELETE)\s*\(", text):
            b = closed(text, m.end() - 1)
            nested = [own.value(text[n.end() : closed(text, n.end() - 1) - 1].split(",")[0])[0] for n in re.finditer(r"\bnest\s*\(\s*(?:RequestPredicates\s*\.\s*)?path\s*\(", text) if n.start() < m.start() < closed(text, text.index("(", n.start()))]
            r, unknown = own.value(split(text[m.end() : b - 1], ",")[0])
            if r:
                yield row("rest", "serve", f"{m[1]} {_route(*[n for n in nested if n], r)}", "webflux", m.start(), b, dynamic=unknown)
    yield from _repositories(text, types, own, row)
    for begin, body, end, _, name in types:
        if "@EnableSwagger2" in text[begin:body]:
            yield row("rest", "serve", "GET /swagger-ui.html", "swagger-ui", begin + text[begin:body].index("@"), body)
        if name.startswith("Rest") and "Config" in name:
            plain = re.sub(rf"{_STRING}|@\w+\s*\([^)]*\)", lambda x: " " * len(x[0]), text[body:end])
            for m in {(x[0], bisect_right(starts, body + x.start())): x for x in re.finditer(r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]*\b", plain)}.values():
                yield row("rest", "call", f"{E.ANY} {E.DYNAMIC}", "configured-client", body + m.start(), body + m.end(), f"api-domain:{m[0].lower().replace('_', '-')}")
            for m in re.finditer(rf"\bgetRest\s*\(\s*\)\s*\.\s*get\s*\(\s*({_STRING})\s*\)", text[body:end]):
                yield row("rest", "call", f"{E.ANY} {E.DYNAMIC}", "configured-external", body + m.start(), body + m.end(), f"external-microservice:{unescaped(m[1][1:-1]).lower()}")
    yield from _kafka(text, own, row)
    for name, pattern in _BLOCKING.items():
        for m in re.finditer(pattern, text):
            yield row("blocking", None, None, name, m.start(), m.end())
    for m in re.finditer(r"@Lock\s*\(\s*(?:value\s*=\s*)?(?:LockModeType\s*\.\s*)?PESSIMISTIC_\w+", text):
        yield row("blocking", None, None, "pessimistic-lock", m.start(), m.end())
    for m in re.finditer(r"\bSpringApplication\.run\s*\(", text):
        yield row("entry", None, None, "spring-boot", m.start(), closed(text, m.end() - 1))
    collections = {}
    for m in re.finditer(r"@Document\b\s*(\()?", text):
        b = closed(text, m.end() - 1) if m[1] else m.end()
        held = next((t for t in types if t[0] <= m.start() < t[1]), None)
        named = own.named(text[m.end() : b - 1], ("collection", "value")) if m[1] else []
        if held:
            collections[held[4]] = (named[0][0] if named else None) or held[4][0].lower() + held[4][1:]
            yield row("collection", None, collections[held[4]], "mongodb", m.start(), b, held[4])
    for m in re.finditer(r"\b\w*[mM]ongo(?:Template|Operations)\w*\s*\.\s*(\w+)\s*\(", text):
        b = closed(text, m.end() - 1)
        kind = re.search(r"\b(\w+)\s*\.\s*class\b", text[m.end() : b])
        yield row("mongo", m[1], collections.get(kind[1]) if kind else None, "mongo-template", m.start(), b, kind[1] if kind else None)
    for begin, body, end, kind, name in types:
        if kind == "enum" and text[body : body + 1] == "{":
            for value in re.findall(r"\b([A-Z][A-Z0-9_]*)\b\s*(?:\([^)]*\))?\s*(?=[,;}])", text[body + 1 : end].split(";")[0] + ";"):
                yield row("field", "enum", value, name, begin, body)
        elif kind == "record":
            inside = text[text.index("(", begin) + 1 : closed(text, text.index("(", begin)) - 1] if "(" in text[begin:body] else ""
            for part in split(inside, ","):
                if m := re.search(r"([\w<>,.\[\]\s]+?)\s+(\w+)$", re.sub(r"@\w+(?:\([^)]*\))?", "", part).strip()):
                    yield row("field", m[1].strip(), m[2], name, begin, body)
        elif kind == "class":
            for m in re.finditer(r"\bprivate\s+(?:final\s+)?([\w.]+(?:\s*<[^;={}()]*>)?(?:\[\])?)\s+(\w+)\s*(?=[;=])", text[body:end]):
                if around(body + m.start()) == (begin, body, end, kind, name):
                    yield row("field", re.sub(r"\s+", "", m[1]), m[2], name, body + m.start(), body + m.end())


def _repositories(text: str, types: list[tuple[int, int, int, str, str]], own: Expressions, row) -> Iterator[tuple]:
    """Routes of Spring Data repositories: six of the collection, and its searches. Without a path of their own they hold only
    where the module has the starter, which ``with_starter`` decides; so those have a framework of their own."""
    for begin, body, end, kind, _ in types:
        entity = re.search(r"\b\w*Repository\s*<\s*([\w.]+)", text[begin:body])
        if kind != "interface" or not entity:
            continue
        note = re.search(r"@RepositoryRestResource\s*\(", text[begin:body])
        arguments = text[begin + note.end() : closed(text, begin + note.end() - 1) - 1] if note else ""
        if re.search(r"\bexported\s*=\s*false\b", arguments):
            continue
        given = [x for x in own.named(arguments, ("path",)) if re.search(r"\bpath\s*=", arguments)]
        framework = "spring-data-rest" if given else "spring-data-rest-default"
        base = _route(given[0][0] if given and given[0][0] else _plural(entity[1].split(".")[-1].lower()))
        for topic in (f"GET {base}", f"POST {base}", f"GET {base}/{{id}}", f"PUT {base}/{{id}}", f"PATCH {base}/{{id}}", f"DELETE {base}/{{id}}"):
            yield row("rest", "serve", topic, framework, begin + re.match(r"\s*", text[begin:body]).end(), body)
        at = body + 1
        while at < end - 1:
            stop = header_end(text, at)
            method = re.sub(r"^\s+", "", text[at:stop])
            name = re.search(r"\b(\w+)\s*\(", re.sub(r"@\w+(?:\s*\((?:[^()]|\([^()]*\))*\))?", "", method))
            hidden = re.search(r"@RestResource\s*\(([^)]*)\)", method)
            if name and stop < end and not (hidden and re.search(r"\bexported\s*=\s*false\b", hidden[1])):
                shown = own.named(hidden[1], ("path",)) if hidden and "path" in hidden[1] else []
                yield row("rest", "serve", f"GET {base}/search/{shown[0][0] if shown else name[1]}", framework, stop - len(method), stop)
            at = balanced(text, stop, "{}") if text[stop : stop + 1] == "{" else stop + 1
            at = end if at < 0 else at


def _plural(word: str) -> str:
    return word + "es" if re.search("(s|x|z|ch|sh)$", word) else word[:-1] + "ies" if re.search("[^aeiou]y$", word) else word + "s"


def _topic_name(name: str) -> str:
    return re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).replace("-", "_").upper()


def _kafka(text: str, own: Expressions, row) -> Iterator[tuple]:
    def topic_of(expression: str) -> str:
        value, unknown = own.value(expression)
        return E.DYNAMIC if value is None or unknown else value

    def payload(arguments: list[str]) -> str | None:
        made = re.search(r"new\s+(\w+)\s*[(<]", ",".join(arguments[1:]))
        if made:
            return made[1]
        declared = re.search(rf"\b([A-Z]\w*)(?:<[^;=()]*>)?\s+{re.escape(arguments[-1])}\s*[=;,)]", text) if len(arguments) > 1 and re.fullmatch(r"\w+", arguments[-1]) else None
        return declared[1] if declared else None

    for m in re.finditer(r"@KafkaListener\s*\(", text):
        b = closed(text, m.end() - 1)
        arguments = text[m.end() : b - 1]
        listened = re.search(r"\(\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:final\s+)?([\w.]+)(?:<[^>]*?([\w.]+)\s*>)?\s+\w+", re.sub(r"^(?:\s*@\w+(?:\([^)]*\))?)*", "", text[b : header_end(text, b)]))
        kind = (listened[2] or listened[1]) if listened else None
        keyed = re.findall(_KEY, arguments)
        for key in keyed:
            yield row("kafka", "consume", _topic_name(key), "kafka-convention", m.start(), b, kind)
        if keyed:
            continue
        exact = [x for x in own.named(arguments, ("topics",)) if re.search(r"\btopics\s*=", arguments) or "=" not in arguments]
        if not exact:
            for part in re.finditer(r"\btopic\s*=(?!=)\s*", arguments):
                exact.append(own.value(split(arguments[part.end() :], ",")[0].split(")")[0]))
        pattern = own.named(arguments, ("topicPattern",)) if not exact and "topicPattern" in arguments else []
        for value, unknown in exact or pattern or [(None, True)]:
            yield row("kafka", "consume", value or E.DYNAMIC, "spring-kafka", m.start(), b, kind, dynamic=unknown or bool(pattern))
    sent = r"\b(?:\w*[kK]afkaTemplate\w*\s*\.\s*send|\w*[sS]treamBridge\w*\s*\.\s*send|new\s+ProducerRecord(?:<[^>]*>)?)\s*\("
    for m in re.finditer(rf"{sent}|{_SENDER}", text):
        b = closed(text, m.end() - 1)
        arguments = split(text[m.end() : b - 1], ",")
        if m[1] and len(arguments) < 2:
            continue
        getter = re.search(_GETTER, arguments[0])
        topic = _topic_name(getter[1]) if getter else topic_of(arguments[0])
        built = re.search(r"KafkaHeaders\s*\.\s*TOPIC\s*,\s*", text[statement_start(own.mask, m.start()) : b])
        if topic == E.DYNAMIC and built:
            at = statement_start(own.mask, m.start()) + built.end()
            topic = topic_of(split(text[at:b], ")")[0])
        yield row("kafka", "produce", topic, "kafka-convention" if getter or m[1] else "kafka", m.start(), b, payload(arguments))
    for m in re.finditer(r"\.\s*(?:(stream)|(to))\s*\(\s*", text):
        begin = text[statement_start(own.mask, m.start()) : m.end()]
        if re.search(r"\b\w*[sS]treams?[bB]uilder\w*|\bKStream\b", begin) or (m[2] and re.search(r"\.\s*(?:stream|mapValues|filter|toStream)\s*\(", begin)):
            b = closed(text, text.index("(", m.start()))
            yield row("kafka", "consume" if m[1] else "produce", topic_of(split(text[m.end() : b - 1], ",")[0]), "kafka-streams", m.start(), b)
    for m in re.finditer(r"\.\s*subscribe\s*\(\s*(?:Collections\.singletonList|List\.of|Arrays\.asList)\s*\(", text):
        b = closed(text, m.end() - 1)
        for value, unknown in (own.value(x) for x in split(text[m.end() : b - 1], ",")):
            yield row("kafka", "consume", value or E.DYNAMIC, "kafka-consumer", m.start(), b, dynamic=unknown)


def facts(texts: DataFrame, extensions: tuple[Callable[[str, str], Iterator[tuple]], ...] = ()) -> DataFrame:
    """All facts of the Java files among (path, text). extensions: extractors of a project's own conventions, called like
    ``facts_of``."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in _FACT.split(", ")]
        for batch in batches:
            yield pd.DataFrame([f for path, text in zip(batch["path"], batch["text"]) if text is not None for extract_one in (facts_of, *extensions) for f in extract_one(path, text)], columns=columns)

    return texts.where(F.col("path").endswith(".java")).select("path", "text").mapInPandas(extract, _FACT)


def with_starter(found: DataFrame, modules: DataFrame) -> DataFrame:
    """Facts without repository routes by default paths in modules that lack the starter for them. modules: (folder,
    dependencies array)."""
    from ..operators.resolve import nearest_owner

    has = F.exists("dependencies", lambda d: d.contains("data-rest"))
    owned = nearest_owner(found.select("path").distinct(), modules.select("folder", has.cast("string").alias("owner")))
    return found.join(owned, "path").where((F.col("framework") != "spring-data-rest-default") | (F.col("owner") == "true")).drop("owner")


def resolved(found: DataFrame, properties: DataFrame) -> DataFrame:
    """Facts with the placeholder of a topic or route replaced by the property nearest to the file, else by its default; where
    there is neither, it stays and is dynamic. One placeholder a topic. properties: (folder, rank, key, value)."""
    from ..operators.resolve import nearest_property

    held = found.withColumn("key", E.placeholder_key(F.col("topic"))).withColumn("default_value", E.placeholder_default(F.col("topic")))
    known = nearest_property(held.where("key IS NOT NULL").groupBy("path", "key").agg(F.min("default_value").alias("default_value")), properties)
    out = held.join(known, ["path", "key"], "left")
    whole = F.regexp_replace("topic", r"(#\{')?\$\{[^}]*\}('\})?", "\u0000")
    topic = F.when(F.col("value").isNotNull(), F.replace(whole, F.lit("\u0000"), F.col("value"))).otherwise(F.col("topic"))
    slashes = F.when(F.col("fact") == "rest", F.regexp_replace(topic, "/{2,}", "/")).otherwise(topic)
    return out.select(*(slashes.alias("topic") if c == "topic" else (F.col("topic_dynamic") & (F.col("value").isNull() | slashes.rlike(r"\{dynamic\}|<dynamic>$"))).alias(c) if c == "topic_dynamic" else F.col(c) for c in found.columns))


def endpoints(found: DataFrame, system: str) -> DataFrame:
    """REST and Kafka facts as endpoints with stable ids; repeated ids count once."""
    marked = F.col("framework").startswith("configured")
    rows = found.where(F.col("fact").isin("rest", "kafka")).withColumn("system", F.lit(system)).withColumn("module", F.lit(system))
    rows = rows.withColumn("snippet", F.when(marked, F.concat_ws("\n", "snippet", "message_type")).otherwise(F.col("snippet"))).withColumn("message_type", F.when(~marked, F.col("message_type")))
    return rows.withColumn("id", E.endpoint_id(F.col("role"), F.col("topic"), F.col("path"), F.col("start_line"), F.col("end_line"))).dropDuplicates(["id"]).drop("fact")
