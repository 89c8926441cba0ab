"""Secret scan by assignment-aware lexing.

Texts are lexed by the rules that source code and configuration share: strings in single, double or triple quotes
(with escapes), comments (whose content is lexed like the rest), names (dotted, dashed or quoted as keys), numbers, operators. Assignments (name = value,
name: value, name := value, name => value, "name": value, name("value") of setters, and bare values of .env and .ini
files up to the end of the line) become pairs of a name and a literal. Constants are propagated: a value that is a
name assigned before stands for that name's literal, and literals or constants joined by + or by juxtaposition are
put together, so a secret that is built in parts, or passed on under a harmless name first, is seen whole.

A literal is scored by its name: the weight of the most sensitive word in it (password, secret, token, key, ...), a
fraction for words that make it harmless (test, example, ...), and the literal's own form: known prefixes of
credentials, entropy for its alphabet, length. Placeholders score 0, and so do literals of fewer than SHORTEST
characters, and those of more than MOST_WORDS words, which are prose, unless the name is that of a phrase. Pairs of score min_score or more are reported.

Defined results: null and empty texts have no secrets. Each pair is reported once for each document row and position,
so repeated rows give repeated results. Names may have any length; a literal put together of parts stops at LONGEST
characters, and types between a name and its value are known up to 24 tokens. A quote that isn't closed is a sign like others. The time is linear in the text. The literal itself isn't given, but its SHA-256 sum, length and first
four characters. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SYNTAX = r"""
    (?P<space>[ \t\r\f\v]+)
  | (?P<line>\n)
  | (?P<block>/\*+|\*+/|<!--|-->)
  | (?P<string>(?:[rRbBuUfF]{1,2}(?=["']))?(?:"(?:[^"\\\n]|\\.)*"|(?<![^\W_])'(?:[^'\\\n]|\\.)*'|`[^`\n]*`))
  | (?P<comment>(?:\#|//|--[ ])(?=[^\n]*))
  | (?P<name>(?:\$\{?)?[^\W\d][\w]*(?:(?:\.|->|::|-)[^\W\d][\w]*)*\}?)
  | (?P<number>\d[\w.]*)
  | (?P<assign>:=|=>|===?|!=|<=|>=|\+=|=|:(?!:|//))
  | (?P<join>\+|\.\.)
  | (?P<open>[(\[{,;])
  | (?P<close>[)\]}])
  | (?P<other>.)
    """
_LEXER = re.compile(_SYNTAX, re.VERBOSE | re.DOTALL)
#: The same where no string starts.
_UNQUOTED = re.compile(re.sub(r"(?m)^  \| \(\?P<string>.*\n", "", _SYNTAX), re.VERBOSE | re.DOTALL)
_BARE = re.compile(r"[^\s#;,'\"()\[\]{}<>]+")
#: A line may hold a pair only if it has one of these signs next to a name or a quoted key.
_SIGN = re.compile(r"[\w\"'\])}][ \t]*(?::=|=>|\+=|=(?!=)|:(?![:/]))\s*\S|\(\s*[\"'`]")

WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9,
    "private": 0.5, "access": 0.5, "key": 0.6, "signature": 0.6, "salt": 0.6, "cookie": 0.5, "session": 0.5, "cert": 0.5, "dsn": 0.7, "webhook": 0.6, "pin": 0.5, "pass": 0.8,
}
#: Names whose literals may be of many words.
PHRASES = {"pass", "passphrase"}
HARMLESS = {"test", "example", "sample", "dummy", "public", "pub", "id", "name", "type", "count", "length", "size", "url", "uri", "path", "file", "field", "label", "header", "max", "min", "num", "limit", "word", "primary", "foreign", "sort", "cache"}
PREFIXES = re.compile(r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|sk_live_\w{10,}|rk_live_\w{10,}|AIza[\w-]{30,}|ya29\.[\w.-]+|eyJ[\w-]{8,}\.[\w-]+\.[\w-]*|-----BEGIN [A-Z ]*PRIVATE KEY)")
PLACEHOLDER = re.compile(r"^(?:|x+|\*+|\.+|-+|_+|<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\})$", re.IGNORECASE)
_STEM = re.compile(r"(?:your|my|change|enter|insert|replace|example|dummy|sample|todo|none|null|nil|true|false|undefined|password|secret|token|key)([A-Za-z_ -]*)$", re.IGNORECASE)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Pair:
    name: str
    literal: str
    position: int
    propagated: bool


def _unquote(token: str) -> str:
    body = token.lstrip("rRbBuUfF") if token[0] not in "\"'`" else token
    raw = body is not token and "r" in token[: len(token) - len(body)].lower()
    for q in ('"""', "'''", '"', "'", "`"):
        if body.startswith(q):
            body = body[len(q) : -len(q)]
            break
    return body if raw else _ESCAPE.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body)


def _bare_name(token: str) -> str:
    return token.strip("${}")


_OPENED = re.compile(r"""(?:[rRbBuUfF]{0,2})(\"\"\"|'''|["'`])""")
_REST = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*', re.DOTALL), "'": re.compile(r"'(?:[^'\\\n]|\\.)*", re.DOTALL), "`": re.compile(r"`[^`\n]*")}


def lex(text: str) -> list[tuple[str, str, int]]:
    """Kind, text and position of the tokens, white space within lines and the marks of comment blocks left out.

    Linear in the text: where a quote isn't closed, no other of its kind up to where it would have to be is tried.
    """
    out: list[tuple[str, str, int]] = []
    dead = {'"': 0, "'": 0, "`": 0, '"""': 0, "'''": 0}
    at, n = 0, len(text)
    while at < n:
        sign = text[at]
        m = None
        if sign in "\"'`" or sign in "rRbBuUfF":
            opened = _OPENED.match(text, at)
            if opened:
                quote, begin = opened[1], opened.start(1)
                if len(quote) == 3:
                    if at >= dead[quote]:
                        closed = text.find(quote, begin + 3)
                        if closed >= 0:
                            out.append(("triple", text[at : closed + 3], at))
                            at = closed + 3
                            continue
                        dead[quote] = n
                    quote = quote[0]
                if at < dead[quote]:
                    m = _UNQUOTED.match(text, at)
                else:
                    m = _LEXER.match(text, at)
                    if m.lastgroup == "other" or m.lastgroup == "name" and begin > at:
                        end = _REST[quote].match(text, begin).end()
                        if text[end : end + 1] != quote:
                            dead[quote] = end
        m = m or _LEXER.match(text, at)
        if m.lastgroup not in ("space", "block"):
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


def pairs(text: str) -> list[Pair]:
    """Names and the literals assigned to them, constants propagated, in order of position."""
    tokens = lex(text)
    constants: dict[str, str] = {}
    out: list[Pair] = []
    i, n = 0, len(tokens)
    while i < n:
        kind, value, at = tokens[i]
        name = None
        if kind == "name":
            name = _bare_name(value)
        elif kind == "string" and i + 1 < n and (tokens[i + 1][0] == "assign" or tokens[i + 1][1] == "]"):
            name = _unquote(value)
        if not name:
            i += 1
            continue
        after = i + 1
        if after < n and tokens[after][1] == "]":  # settings["name"] = value
            after += 1
        after, kind_name = _annotated(tokens, after)
        called = False
        if after + 1 < n and kind == "name" and tokens[after][1] == "(" and tokens[after + 1][0] == "string":
            called = after + 2 < n and tokens[after + 2][1] == ")"
        if not called and not (after < n and tokens[after][0] == "assign" and tokens[after][1] in ("=", ":", ":=", "=>", "+=")):
            i += 1
            continue
        literal, propagated, j = _value(text, tokens, after + 1, constants)
        if literal is None:
            i = after + 1
            continue
        if kind_name and sensitivity(kind_name) > sensitivity(name):  # if password: token = "..." has no annotation
            name = kind_name
        if tokens[after][1] == "+=":
            literal, propagated = (constants.get(name, "") + literal)[:LONGEST], True
        if not called:
            constants[name] = constants[name.rsplit(".", 1)[-1]] = literal
        out.append(Pair(name, literal, at, propagated))
        while not called and tokens[after + 1][0] in ("open", "line") and j < n and tokens[j][1] == ",":  # the list's other values
            literal, propagated, after_it = _value(text, tokens, j, constants)
            if literal is None:
                break
            out.append(Pair(name, literal, tokens[after_it - 1][2], propagated))
            j = after_it
        i = max(j, after + 1)
    return out


_TYPE_SIGNS = {"[", "]", "<", ">", "|", "&", "*", "?", "'", "(", ")", "{", "}"}
_BEFORE_TYPE = {"static", "mut", "const", "dyn", "final", "readonly", "unsigned", "'"}


def _annotated(tokens: list[tuple[str, str, int]], j: int) -> tuple[int, str | None]:
    """The sign after a name: j, or that after a type that stands at j (": str =", "?: string =", "string =" of Go), and the type's last name."""
    n, begin = len(tokens), j
    if j < n and tokens[j][1] in ("?", "!"):
        j += 1
    typed = j < n and tokens[j][1] == ":"
    if typed:
        j += 1
    elif not (j < n and (tokens[j][1] in ("string", "[") and j == begin)):
        return begin, None
    last, depth, first = None, 0, j
    while j < n and j < first + 24:
        kind, value, _ = tokens[j]
        if value == "=" and depth == 0:
            whole = typed or tokens[j - 1][1] == "string"
            return (j, last if typed else None) if last and whole else (begin, None)
        if kind == "name":
            if j > first and tokens[j - 1][0] == "name" and tokens[j - 1][1] not in _BEFORE_TYPE:
                break
            last = _bare_name(value)
        elif value == "," and depth or value in _TYPE_SIGNS:
            depth += (value in ("[", "(", "{", "<")) - (value in ("]", ")", "}", ">"))
        else:
            break
        j += 1
    return begin, None


def _opened(tokens: list[tuple[str, str, int]], j: int) -> int:
    """The string that token j leads to by opening brackets, commas, line ends and list types alone, or j."""
    n, begin = len(tokens), j
    while j < n and (tokens[j][0] in ("open", "line") and tokens[j][1] != ";" or tokens[j][1] == "]" or tokens[j][0] == "name" and j + 1 < n and tokens[j + 1][1] == "{" and j > begin and tokens[j - 1][1] == "]"):
        j += 1
    if j > begin and j < n and tokens[j][0] in ("string", "triple") and not (j + 1 < n and tokens[j + 1][0] == "assign"):
        return j
    return begin


def _value(text: str, tokens: list[tuple[str, str, int]], j: int, constants: dict[str, str]) -> tuple[str | None, bool, int]:
    """The literal that starts at token j, whether it came through constants, and the token after it."""
    parts: list[str] = []
    propagated, n, begin = False, len(tokens), j
    j = _opened(tokens, j)
    wrapped = any(tokens[k][1] == "(" for k in range(begin, j))  # strings on several lines are one
    while j < n:
        kind, value, at = tokens[j]
        if kind in ("string", "triple"):
            parts.append(_unquote(value))
        elif kind == "name" and _bare_name(value) in constants and (not parts or tokens[j - 1][0] == "join"):
            parts.append(constants[_bare_name(value)])
            propagated = True
        else:
            break
        j += 1
        after = j
        while wrapped and after < n and tokens[after][0] == "line":
            after += 1
        if after < n and tokens[after][0] in ("string", "triple", "join"):
            j = after
        if j < n and tokens[j][0] == "join":
            j += 1
            while j < n and tokens[j][0] == "line":
                j += 1
        elif not (j < n and tokens[j][0] in ("string", "triple") and parts and (wrapped or tokens[j - 1][0] in ("string", "triple"))):
            break
    if parts:
        return "".join(parts) if len(parts) == 1 else "".join(parts)[:LONGEST], propagated or len(parts) > 1, j
    if begin < n and tokens[begin][0] in ("name", "number", "other", "join"):
        m = _BARE.match(text, tokens[begin][2])
        if m:
            while j < n and tokens[j][2] < m.end():
                j += 1
            if not (j < n and tokens[j][1] in ("(", "[")):  # a call or an index isn't a literal
                bare = m[0].removesuffix("--") if text.startswith(">", m.end()) else m[0].removesuffix("*/")  # a comment's end
                return bare, False, j
    return None, False, begin


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


#: Characters after which a literal that is put together of parts stops growing.
LONGEST = 1 << 12
#: Literals of fewer characters score 0 unless they have the form of a known credential.
SHORTEST = 6
#: Words that a literal may have, but under the names of PHRASES.
MOST_WORDS = 4
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_words(name: str) -> list[str]:
    words = [w.lower() for w in _SPLIT.findall(name)]
    return words + [a + b for a, b in zip(words, words[1:])]


def _weight(word: str) -> float:
    """The weight of a word, of its singular, or of one of five letters or more that it ends with (authtoken)."""
    for w in (word, word.removesuffix("s")):
        if w in WEIGHTS:
            return WEIGHTS[w]
    return max((weight for w, weight in WEIGHTS.items() if len(w) >= 5 and word.removesuffix("s").endswith(w)), default=0.0)


@lru_cache(10_000)
def sensitivity(name: str) -> float:
    """The weight of the most sensitive word in a name."""
    return max(map(_weight, name_words(name)), default=0.0)


def placeholder(literal: str) -> bool:
    """Whether the literal stands for one to be put in: a sign, or a stem and words after it, without digits or random letters."""
    if PLACEHOLDER.match(literal):
        return True
    m = _STEM.match(literal)
    if not m:
        return False
    words = _SPLIT.findall(m[1])
    return not words or max(map(len, words)) <= 12 and sum(map(len, words)) >= 3 * len(words) - 2


def score(name: str, literal: str) -> float:
    """Between 0 and 1: how much the pair looks like a secret."""
    if PREFIXES.match(literal):
        return 1.0
    words = name_words(name)
    if len(literal) < SHORTEST or placeholder(literal) or literal.count(" ") >= MOST_WORDS and not PHRASES.intersection(words):
        return 0.0
    sensitive = sensitivity(name)
    if not sensitive:
        return 0.0
    if any(w in HARMLESS for w in words):
        sensitive *= 0.4
    form = min(1.0, entropy(literal) / 3.5) * min(1.0, len(literal) / 12)
    if literal.isalpha() and literal.islower() and len(literal) < 16:
        form *= 0.6
    return round(sensitive * form, 6)


SECRETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("name", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("sha256", T.StringType()), T.StructField("propagated", T.BooleanType()), T.StructField("score", T.DoubleType())])


def scan_text(text: str | None, min_score: float) -> list[tuple]:
    if not text or not _SIGN.search(text):
        return []
    out = []
    for p in pairs(text):
        s = score(p.name, p.literal)
        if s >= min_score:
            out.append((p.position, p.name, p.literal[:4], len(p.literal), hashlib.sha256(p.literal.encode()).hexdigest(), p.propagated, s))
    return out


def scan(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """doc_id, position (in characters), name, prefix, length, sha256, propagated and score of each secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *found) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for found in scan_text(text, min_score)]
            columns = list(zip(*rows)) if rows else [()] * len(SECRETS)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SECRETS.names)

    # only such texts can hold a pair; the test runs before they leave the JVM
    return docs.select("doc_id", "text").where(F.col("text").rlike("[=:]|\\(\\s*[\"'`]")).mapInArrow(run, SECRETS)
