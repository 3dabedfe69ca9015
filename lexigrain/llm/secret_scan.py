"""Secrets by assignment-aware lexing (operator 10).

A lexer reads pairs of a name and a value out of any text: assignments (``name = v``, ``name: v``, ``"name": v``,
``name := v``, ``name ?= v``, ``name => v``, ``name <- v``, ``obj["name"] = v``, ``name: type = v``, ``--name=v``, ``#define NAME v``),
calls (``get("name", v)``, ``define('name', v)``) and markup (``<name>v</name>``, ``name="key" value="v"`` in a tag).
A value is an expression: strings in single, double, triple or back quotes with their escapes, bare words, names bound
before it in the same text, what ``$name``, ``${name}`` or an f-string's ``{name}`` puts into a string, sums of these,
strings side by side, parentheses over several lines with comments, lists, alternatives (``or``, ``||``, ``??``), wrappers
like ``str("v")``, and YAML's indented blocks. ``name += v`` extends what the name holds. Comments are read like code.

Bound values are kept as references, never as joined strings, so ``x = x + x`` costs the same in every line. Each
literal is scored by how sensitive the words of the target's name are, times how much the value that it is part of
looks like a key; findings reach ``THRESHOLD``.

Findings are (doc_id, name, begin, length, score, digest): position and length of the literal in
characters and its SHA-256, never the literal itself. A literal that several names hold counts once, with
the best-scored name (the first of equal ones).

Defined cases: null and empty texts have no findings; texts, names and values of any length are read whole, in time in
proportion to their length; a private key's header that several literals make up is found if it lies within 2048 characters of
both sides of their joint; repeated rows give repeated findings; columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import textkit

THRESHOLD = 0.5
MIN_LITERAL = 6
MASK = "[secret]"

_WORD = r"[^\W\d][\w$]*"
_NAME = rf"\$?{_WORD}(?:(?:\.|->|::|-){_WORD})*"
#: Names and operators in order; what is quoted is scanned too, as prose has apostrophes.
_SCAN = re.compile(
    rf"#[ \t]*define[ \t]+(?P<macro>{_NAME})[ \t]+|(?P<name>{_NAME})|\(\s*(?P<quote>[\"'])(?P<key>[^\"'\n]+)(?P=quote)\s*,|(?P<op>:=|=>|\+=|\?\?=|\?=|\|\|=|<-(?!-)|(?<![=!<>:+*/%&|^~?-])=(?![=>~])|(?<!:):(?![:=/]))"
)
_STRING = re.compile(r"(?P<prefix>[rbfuRBFU]{0,2})(?P<open>\"\"\"|'''|[\"'`])")
_ENDS = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*(?=")'),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*(?=')"),
    "`": re.compile(r"[^`]*(?=`)"),
    3 * '"': re.compile(r'(?:[^"\\]|\\.|"(?!""))*(?=""")', re.S),
    3 * "'": re.compile(r"(?:[^'\\]|\\.|'(?!''))*(?=''')", re.S),
}
_TERM = re.compile(_NAME)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>#]+")
_SPACE = re.compile(r"(?:[ \t]|\\\r?\n)*")
_LINES = re.compile(r"(?:\s|\\\r?\n|#[^\n]*|//[^\n]*)*")
_TO_QUOTE = re.compile(r"\s*(?=[\"'`])")
_PLUS = re.compile(r"(?:\+(?!=)|\.\.(?!\.)|&(?!&)|\.(?=[ \t]*[\"']))")
_OTHERWISE = re.compile(r"(?:or\b|\|\||\?\?(?!=))")
_ANNOTATION = re.compile(r"&?(?:'\w+[ \t]+)?[^\W\d][\w.]*(?:[ \t]*[\[<][^\]>\n=:]*[\]>])?\??[ \t]*=(?![=>~])")
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?\r?\n")
_INSERTED = re.compile(r"\$\{(?P<a>[^\W\d]\w*)\}|\$(?P<b>[^\W\d]\w*)")
_FORMATTED = re.compile(r"\{(?P<a>[^\W\d][\w.]*)\}")
_WRAPPERS = frozenset("str string bytes bytearray secretstr secretbytes secret securestring sensitive some ok b64decode base64 decode encode tostring to_string from from_str new trim strip quote".split())
_TYPES = frozenset("string str text char byte bytes String STRING VARCHAR varchar".split())
_ELEMENT = re.compile(r"<(?P<tag>[^\W\d][\w.:-]*)(?P<rest>\s[^<>]*)?>(?P<value>[^<>]+)</(?P=tag)\s*>")
_TAG = re.compile(r"<[^\W\d][\w.:-]*\s[^<>]*>")
_ATTRIBUTE = re.compile(r"(?P<name>[\w.:-]+)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)')")
#: Of a value of more characters than this the text of both ends is kept, and of what lies between the characters that occur.
_WHOLE = 4096
_END = _WHOLE // 2

_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 1.0, "credentials": 1.0,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "bearer": 0.9, "auth": 0.6, "authorization": 0.8, "jwt": 0.9, "signature": 0.6, "salt": 0.6, "key": 0.6, "pat": 0.6, "cookie": 0.6, "session": 0.5,
}
_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("auth", "key"), ("encryption", "key"), ("signing", "key"), ("client", "secret"), ("auth", "token"), ("access", "token"), ("connection", "string")}
#: Every name with a score holds one of these.
_STEMS = sorted({*_SENSITIVE, *(b for _, b in _PAIRS)}, key=len)
_STEMS = [w for i, w in enumerate(_STEMS) if not any(x in w for x in _STEMS[:i])]
_HARMLESS = {"public": 0.2, "example": 0.3, "sample": 0.3, "placeholder": 0.1, "length": 0.1, "len": 0.1, "count": 0.1, "size": 0.1, "file": 0.3, "path": 0.3, "url": 0.3, "uri": 0.3, "name": 0.4, "type": 0.2, "field": 0.2, "regex": 0.1, "pattern": 0.1, "policy": 0.1, "hint": 0.2, "expiry": 0.2, "expires": 0.2, "limit": 0.1, "max": 0.2, "min": 0.2, "label": 0.2, "prompt": 0.2}
_EMPTY = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|test(?:ing)?|example.*|change_?me|your.*|my_?(?:password|secret|token)|password|secret|token|dummy|placeholder|redacted|todo|x+|\*+|\.+|-+|<.*>|\[secret\]|\$\{.*\}|\{\{.*\}\}|%\(.*\).?|\$[A-Z_]+)$")
_KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|xox[abprs]-[\w-]{10,}|sk[-_][\w-]{16,}|AIza[\w-]{30,}|eyJ[\w-]+\.[\w-]+\.[\w-]*)$")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a target of this name is, from 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max([_SENSITIVE.get(w, _SENSITIVE.get(w.removesuffix("s"), 0.0)) for w in words], default=0.0)
    if any(pair in _PAIRS for pair in zip(words, words[1:])):
        best = 1.0
    for w in words:
        best *= _HARMLESS.get(w, 1.0)
    return best


@dataclass
class Value:
    """What is known of a value: its length, each character's share, its text, of long ones the ends and the characters between
    them (``inner``), and whether a private key's header stands anywhere in it."""

    length: float
    shares: dict[str, float]
    text: str
    bare: bool
    inner: frozenset[str]
    pem: bool

    @staticmethod
    def of(text: str, bare: bool = False) -> Value:
        shares = {c: n / len(text) for c, n in Counter(text).items()} if text else {}
        return Value(len(text), shares, *Value._cut(text, bare, frozenset()), _PEM.search(text) is not None)

    @staticmethod
    def _cut(text: str, bare: bool, inner: frozenset[str]) -> tuple[str, bool, frozenset[str]]:
        if len(text) <= _WHOLE:
            return text, bare, inner
        return text[:_END] + text[-_END:], bare, inner.union(text[_END:-_END])

    def plus(self, other: Value) -> Value:
        bare = self.bare and other.bare
        if not self.length or not other.length:
            return replace(self if self.length else other, bare=bare)
        # Lengths may double in every line of a text.
        total = min(self.length + other.length, 1e300)
        part = self.length / (self.length + other.length)
        shares = {c: self.shares.get(c, 0.0) * part + other.shares.get(c, 0.0) * (1 - part) for c in {**self.shares, **other.shares}}
        pem = self.pem or other.pem or ("-" in self.shares and _PEM.search(self.text[-_END:] + other.text[:_END]) is not None)
        return Value(total, shares, *Value._cut(self.text + other.text, bare, self.inner | other.inner), pem)

    def score(self) -> float:
        """How much it looks like a key or password, from 0 to 1."""
        if self.pem:
            return 1.0
        # What these forms ask of a long middle depends on its characters alone.
        judged = self.text[:_END] + "".join(sorted(self.inner)) + self.text[_END:] if self.inner else self.text
        if self.length < MIN_LITERAL or _EMPTY.match(judged) or any(c.isspace() for c in self.shares):
            return 0.0
        if self.length <= _WHOLE and _KNOWN.match(self.text):
            return 1.0
        entropy = -sum(x * math.log2(x) for x in self.shares.values() if x > 0)
        kinds = sum((any(c.islower() for c in self.shares), any(c.isupper() for c in self.shares), any(c.isdigit() for c in self.shares), any(not c.isalnum() for c in self.shares)))
        digits = any(c.isdigit() for c in self.shares)
        if self.bare and not (digits and kinds >= 2):
            return 0.2
        score = min(1.0, entropy / 3.0) * (1.0 if digits else 0.8) * (1.0 if kinds > 1 else 0.7)
        return min(1.0, score + (0.2 if self.length >= 16 and digits else 0.0))


class Lexer:
    """Pairs of a text. ``nodes`` are sums: of leaves, which are spans of the text, and of earlier nodes, by index."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.nodes: list[list[int | tuple[int, int, bool]]] = []
        self.pairs: list[tuple[str, int]] = []
        self.bound: dict[str, int] = {}
        self.closed = text.rfind("*/")
        #: Where long runs of white space and comments begin and end, so that none is read once for each operator in it.
        self.begun: list[int] = []
        self.ended: list[int] = []
        self._scan()
        self._markup()

    def _node(self, terms: list) -> int:
        self.nodes.append(terms)
        return len(self.nodes) - 1

    def _skip(self, at: int, lines: bool) -> int:
        """Past white space and block comments; over line ends and line comments too if ``lines``."""
        text = self.text
        while True:
            near = bisect(self.begun, at) - 1
            if lines and near >= 0 and at < self.ended[near] and text[at] == "\n":
                at = self.ended[near]
            end = (_LINES if lines else _SPACE).match(text, at).end()
            if lines and end > at + 64:
                self.begun.insert(near + 1, at)
                self.ended.insert(near + 1, end)
            if text.startswith("/*", end) and end < self.closed:
                at = text.index("*/", end + 2) + 2 if text.find("*/", end + 2) >= 0 else end
                if at > end:
                    continue
            return end

    def _string(self, at: int) -> tuple[list, int] | None:
        """Terms of the string that begins here, and where it ends."""
        begun = _STRING.match(self.text, at)
        if not begun:
            return None
        quote = begun["open"]
        inside = _ENDS[quote].match(self.text, begun.end())
        if not inside:
            return None
        a, b = inside.span()
        terms, done = [], a
        if quote != "'":
            for m in (_FORMATTED if "f" in begun["prefix"].lower() else _INSERTED).finditer(self.text, a, b):
                name = m["a"] or m.groupdict().get("b")
                if name in self.bound:
                    if m.start() > done:
                        terms.append((done, m.start(), False))
                    terms.append(self.bound[name])
                    done = m.end()
        if b > done or not terms:
            terms.append((done, b, False))
        return terms, b + len(quote)

    def _reference(self, at: int) -> tuple[list, int] | None:
        """A name bound before."""
        name = _TERM.match(self.text, at)
        for known in (name[0], name[0].removeprefix("$")) if name else ():
            if known in self.bound:
                return [self.bound[known]], name.end()
        return None

    def _call(self, name: str, at: int) -> tuple[list, int] | None:
        """Terms of a call's value, from its opening parenthesis: what a wrapper wraps, or a default."""
        first = self._string(self._skip(at + 1, True))
        if not first:
            return None
        end = self._skip(first[1], True)
        if self.text.startswith(",", end):
            # The first argument is a name, which the scan pairs with the second too.
            second = self._skip(end + 1, True)
            return self._string(second) or self._reference(second)
        wraps = re.split(r"\.|->|::", name)[-1].lower() in _WRAPPERS
        return (first[0], end + 1) if wraps and self.text.startswith(")", end) else None

    def _term(self, at: int, lines: bool) -> tuple[list, int] | None:
        text = self.text
        found = self._string(at)
        if found:
            terms, end = found
            # Strings side by side are one.
            while (more := self._string(self._skip(end, lines))) and not text.startswith(":", more[1]):
                terms, end = terms + more[0], more[1]
            return terms, end
        while (name := _TERM.match(text, at)) and name[0] == "new":
            at = self._skip(name.end(), lines)
        if name:
            if text.startswith("(", name.end()):
                return self._call(name[0], name.end())
            if text.startswith("[", name.end()):
                return None
            if known := self._reference(at):
                return known
        bare = _BARE.match(text, at)
        return ([(at, bare.end(), True)], bare.end()) if bare else None

    def _sum(self, at: int, lines: bool) -> tuple[list, int] | None:
        """Terms of a sum, parentheses around any part of it, and where it ends."""
        terms, end, opened = [], at, 0
        while True:
            while self.text.startswith("(", at):
                opened += 1
                at = self._skip(at + 1, True)
            found = self._term(at, lines or opened > 0)
            if not found:
                break
            terms += found[0]
            end = found[1]
            while opened and self.text.startswith(")", past := self._skip(end, True)):
                opened -= 1
                end = past + 1
            plus = _PLUS.match(self.text, self._skip(end, lines or opened > 0))
            if not plus:
                break
            at = self._skip(plus.end(), True)
        return (terms, end) if terms else None

    def _block(self, at: int, key: int) -> list | None:
        """Lines of a YAML block that is indented more than the line of its key."""
        begun = _BLOCK.match(self.text, at)
        if not begun:
            return None
        text, terms, end = self.text, [], begun.end()
        line = text.rfind("\n", 0, key) + 1
        indent = key - line - len(text[line:key].lstrip(" "))
        while end < len(text):
            stop = text.find("\n", end)
            stop = len(text) if stop < 0 else stop
            body = text[end:stop]
            if body.strip():
                own = len(body) - len(body.lstrip(" "))
                if own <= indent:
                    break
                terms.append((end + own, end + len(body.rstrip()), False))
            end = stop + 1
        return terms or None

    def _values(self, at: int, colon: bool, key: int) -> list[list]:
        """Alternatives that a name is given from here on."""
        text = self.text
        at = self._skip(at, False)
        at = quoted.end() if (quoted := _TO_QUOTE.match(text, at)) else at
        if colon:
            block = self._block(at, key)
            if block:
                return [block]
            typed = _ANNOTATION.match(text, at)
            if typed:
                return self._values(typed.end(), False, key)
        out, listed = [], text.startswith("[", at)
        if listed:
            at = self._skip(at + 1, True)
        while found := self._sum(at, listed):
            out.append(found[0])
            at = self._skip(found[1], listed)
            other = _OTHERWISE.match(text, at)
            if other:
                at = self._skip(other.end(), True)
            elif listed and text.startswith(",", at):
                at = self._skip(at + 1, True)
            else:
                break
        return out

    def _scan(self) -> None:
        text = self.text
        name, at, end, before, line = "", 0, -1, ("", -1), 0
        for m in _SCAN.finditer(text):
            if m["name"]:
                # In ``name string = v`` the type stands between.
                before = (name, end) if text[end : m.start()].strip(" \t") == "" and end >= 0 and m["name"] in _TYPES else ("", -1)
                name, at, end = m["name"], m.start(), m.end()
                continue
            if m["key"] or m["macro"]:
                self._pair(m["key"] or m["macro"], m.start(), m.end(), "(")
                continue
            stop = m.start()
            while stop > 0 and text[stop - 1] in " \t":
                stop -= 1
            fresh = text.rfind("\n", line, stop)
            line = fresh + 1 if fresh >= 0 else line
            if stop == end:
                self._pair(before[0] or name, at, m.end(), m["op"])
                continue
            last = stop - 1
            if last >= line and text[last] == "]":
                last -= 1
                while last >= line and text[last].isdigit():
                    last -= 1
                if last >= line and text[last] == "[" and last == end:
                    self._pair(name, at, m.end(), m["op"])
                    continue
            if last > line and text[last] in "\"'":
                opened = text.rfind(text[last], line, last)
                if opened >= 0 and opened + 1 < last:
                    self._pair(text[opened + 1 : last], opened, m.end(), m["op"])

    def _pair(self, name: str, key: int, at: int, op: str) -> None:
        for terms in self._values(at, op == ":", key):
            if op == "+=" and name in self.bound:
                terms = [self.bound[name], *terms]
            node = self._node(terms)
            self.bound[name] = node
            self.pairs.append((name, node))

    def _markup(self) -> None:
        if "<" not in self.text:
            return
        for m in _ELEMENT.finditer(self.text):
            a, b = m.span("value")
            value = m["value"]
            a, b = a + len(value) - len(value.lstrip()), b - len(value) + len(value.rstrip())
            named = [x["a"] or x["b"] or "" for x in _ATTRIBUTE.finditer(m["rest"] or "") if x["name"].lower() in ("name", "key", "id")]
            if b > a:
                node = self._node([(a, b, False)])
                self.pairs += [(name, node) for name in (m["tag"], *named)]
        for m in _TAG.finditer(self.text):
            found = {x["name"].lower(): x for x in _ATTRIBUTE.finditer(self.text, *m.span())}
            value = found.get("value")
            for key in ("name", "key", "id"):
                if value and key in found:
                    span = value.span("a") if value["a"] is not None else value.span("b")
                    self.pairs.append((found[key]["a"] or found[key]["b"] or "", self._node([(*span, False)])))


def findings(text: str) -> list[tuple[str, int, int, float]]:
    """(name, begin, end, score) of the secret literals, in order of position."""
    read = Lexer(text)
    weights = [(name, node, weight) for name, node in read.pairs if (weight := name_score(name))]
    needed = {node for _, node, _ in weights}
    for node in range(len(read.nodes) - 1, -1, -1):
        if node in needed:
            needed.update(x for x in read.nodes[node] if isinstance(x, int))
    values: dict[int, Value] = {}
    for node in sorted(needed):
        value = None
        for term in read.nodes[node]:
            one = values[term] if isinstance(term, int) else Value.of(text[term[0] : term[1]], term[2])
            value = one if value is None else value.plus(one)
        values[node] = value or Value.of("")
    # The best score comes down from each sum to what it is made of; a sum's terms are older than it is.
    best: dict[int | tuple[int, int], tuple[float, int, str]] = {}
    scores: dict[int, float] = {}
    for order, (name, node, weight) in enumerate(weights):
        if node not in scores:
            scores[node] = values[node].score()
        if weight * scores[node] >= THRESHOLD:
            best[node] = max(best.get(node, (0.0, 0, "")), (weight * scores[node], -order, name))
    for node in range(len(read.nodes) - 1, -1, -1):
        if node in best:
            for term in read.nodes[node]:
                key = term if isinstance(term, int) else term[:2]
                best[key] = max(best.get(key, (0.0, 0, "")), best[node])
    return [(name, *span, score) for span, (score, _, name) in sorted((k, v) for k, v in best.items() if isinstance(k, tuple) and k[1] > k[0])]


def _candidates(texts: pa.Array) -> list[int]:
    """Rows that can have findings: a word that makes a name sensitive and an operator's character, both anywhere."""
    operator = pc.match_substring_regex(texts, r"[:=<(]|#[ \t]*define")
    sensitive = pc.match_substring_regex(texts, "|".join(_STEMS), ignore_case=True)
    return pc.indices_nonzero(pc.fill_null(pc.and_(operator, sensitive), False)).to_pylist()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, name, begin, length, score, digest) of every secret literal; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                texts, rows = part.column("text"), []
                for i in _candidates(texts):
                    text = texts[i].as_py()
                    rows += [(i, name, a, b - a, score, hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest()) for name, a, b, score in findings(text)]
                row, name, begin, length, score, digest = map(list, zip(*rows)) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(begin, pa.int32()), pa.array(length, pa.int32()), pa.array(score, pa.float64()), pa.array(digest, pa.string())],
                    names=["doc_id", "name", "begin", "length", "score", "digest"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, name string, begin int, length int, score double, digest string")


def redact_text(text: str) -> str:
    """The text with its secret literals masked; overlapping literals are masked once."""
    out, at = [], 0
    for _, a, b, _ in findings(text):
        if a >= at:
            out += [text[at:a], MASK]
            at = b
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same documents with secret literals masked in ``text``, and ``n_chars`` counted again where that changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                texts = part.column("text")
                changed = {i: new for i in _candidates(texts) if (new := redact_text(old := texts[i].as_py())) != old}
                if changed:
                    values = texts.to_pylist()
                    for i, new in changed.items():
                        values[i] = new
                    mask = pa.array([i in changed for i in range(part.num_rows)])
                    part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(values, texts.type))
                    if "n_chars" in part.schema.names:
                        at = part.schema.get_field_index("n_chars")
                        counted = pc.utf8_length(part.column("text")).cast(part.column(at).type)
                        part = part.set_column(at, "n_chars", pc.if_else(mask, counted, part.column(at)))
                yield part

    return docs.mapInArrow(run, docs.schema)
