"""Rewrites SQL that Spark does not read, or reads in another sense, into SQL that it does.

The text is cut into tokens (strings, quoted names, comments, numbers, words, marks), so that nothing
inside a literal or comment is touched. What is rewritten: functions under other names, SIMILAR TO,
DISTINCT ON, QUALIFY, GROUPS frames, unnest, lists in square brackets, ordered aggregates, and the order of
nulls, which sort as the largest values unless the query says otherwise.
"""

from __future__ import annotations

import re

from sparkweave.functions.aliases import RENAMED, TEMPLATES

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>[eErRxX]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)"""
    r"""|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<param>\$\d+)|(?P<mark><=>|<>|!=|<=|>=|\|\||::|->|.)""",
    re.S | re.X,
)
Token = tuple[str, str]


def tokens(text: str) -> list[Token]:
    """(kind, text) of all tokens; comments become a space."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup or "mark"
        out.append(("space", " ") if kind == "comment" else (kind, m[0]))
    return out


def text_of(parts: list[Token]) -> str:
    return "".join(t for _, t in parts)


def statements(text: str) -> list[str]:
    """The statements of a text, cut at semicolons outside of literals, names and comments."""
    out: list[list[Token]] = [[]]
    for token in tokens(text):
        if token == ("mark", ";"):
            out.append([])
        else:
            out[-1].append(token)
    return [s for part in out if (s := text_of(part).strip())]


def _word(token: Token) -> str:
    return token[1].upper() if token[0] == "word" else token[1] if token[0] == "mark" else ""


def _closing(parts: list[Token], at: int) -> int:
    """The position of the bracket that closes the one at `at`."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k] == ("mark", "(")) - (parts[k] == ("mark", ")"))
        if depth == 0:
            return k
    raise ValueError("a bracket is not closed")


def _next(parts: list[Token], at: int) -> int:
    """The position of the first token from `at` on that is no space; the length if there is none."""
    while at < len(parts) and parts[at][0] == "space":
        at += 1
    return at


def split(parts: list[Token], mark: str = ",") -> list[list[Token]]:
    """The parts between marks outside of brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for token in parts:
        depth += (token[1] in "([" and token[0] == "mark") - (token[1] in ")]" and token[0] == "mark")
        if depth == 0 and token == ("mark", mark):
            out.append([])
        else:
            out[-1].append(token)
    return out


def _find(parts: list[Token], *words: str, start: int = 0) -> int:
    """The position outside of brackets at which one of the words stands; -1 if none does."""
    depth = 0
    for k in range(start, len(parts)):
        depth += (parts[k] == ("mark", "(")) - (parts[k] == ("mark", ")"))
        if depth == 0 and _word(parts[k]) in words:
            return k
    return -1


def clause(parts: list[Token], word: str) -> tuple[list[Token], list[Token]]:
    """What stands before a word outside of brackets, and after it."""
    at = _find(parts, word)
    return (parts, []) if at < 0 else (parts[:at], parts[at + 1 :])


def _names(parts: list[Token]) -> list[Token]:
    """Names in double quotes in Spark's back quotes."""
    return [("name", "`" + t[1:-1].replace('""', '"').replace("`", "``") + "`") if k == "name" and t[0] == '"' else (k, t) for k, t in parts]


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as a regular expression for the whole text."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        k += 1
    return f"(?s)^(?:{''.join(out)})$"


def _literal(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _similar(parts: list[Token]) -> list[Token]:
    out, k = [], 0
    while k < len(parts):
        if _word(parts[k]) == "SIMILAR" and _word(parts[n := _next(parts, k + 1)] if _next(parts, k + 1) < len(parts) else ("", "")) == "TO":
            at = _next(parts, n + 1)
            if parts[at][0] != "string":
                raise ValueError("SIMILAR TO takes a literal pattern")
            out += [("word", "RLIKE"), ("space", " "), ("string", _literal(similar_pattern(parts[at][1][1:-1].replace("''", "'"))))]
            k = at + 1
        else:
            out.append(parts[k])
            k += 1
    return out


def _ordered(name: str, inner: list[Token], by: int) -> list[Token]:
    """An aggregate with ORDER BY among its arguments: rows are collected with their keys, sorted and stripped again."""
    values = [text_of(_functions(v)).strip() for v in split(inner[:by])]
    keys, tests = [], []
    for k, item in enumerate(split(inner[_next(inner, by + 1) + 1 :])):
        words = [_word(t) for t in item]
        down, first = "DESC" in words, "FIRST" in words if "NULLS" in words else "DESC" in words
        end = min([n for n, w in enumerate(words) if w in ("ASC", "DESC", "NULLS")], default=len(item))
        keys.append(f"{text_of(_functions(item[:end])).strip()} AS k{k}")
        low, null = (1, -1 if first else 1) if down else (-1, -1 if first else 1)
        tests.append(f"WHEN NOT l.k{k} <=> r.k{k} THEN CASE WHEN l.k{k} IS NULL THEN {null} WHEN r.k{k} IS NULL THEN {-null} WHEN l.k{k} < r.k{k} THEN {low} ELSE {-low} END")
    rows = f"array_sort(collect_list(struct({values[0]} AS v, {', '.join(keys)})), (l, r) -> CASE {' '.join(tests)} ELSE 0 END)"
    listed = f"transform({rows}, e -> e.v)"
    made = {"array_agg": listed, "string_agg": f"array_join(transform({rows}, e -> CAST(e.v AS STRING)), {values[-1]})", "first_value": f"try_element_at({listed}, 1)", "last_value": f"try_element_at({listed}, -1)", "nth_value": f"try_element_at({listed}, CAST({values[-1]} AS INT))"}
    return [("mark", "("), *tokens(made[name]), ("mark", ")")]


_ORDERED = {"array_agg", "string_agg", "first_value", "last_value", "nth_value"}


def _square(parts: list[Token], at: int) -> int:
    """The position of the square bracket that closes the one at `at`."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k] == ("mark", "[")) - (parts[k] == ("mark", "]"))
        if depth == 0:
            return k
    raise ValueError("a square bracket is not closed")


def _brackets(parts: list[Token]) -> list[Token]:
    """[a, b] as a list, x[i] as an element counted from one, or null past the end, x[i:j] as a slice."""
    out, k = [], 0
    while k < len(parts):
        if parts[k] != ("mark", "["):
            out.append(parts[k])
            k += 1
            continue
        end = _square(parts, k)
        inner, k = _brackets(parts[k + 1 : end]), end + 1
        start = _operand(out)
        if start == len(out):
            out += tokens(f"array({text_of(inner)})")
            continue
        of, bounds = text_of(out[start:]), [text_of(b).strip() for b in split(inner, ":")]
        out = out[:start] + tokens(f"array_slice({of}, {bounds[0] or 1}, {bounds[1] or -1})" if len(bounds) > 1 else f"try_element_at({of}, {bounds[0]})")
    return out


#: Words after which a square bracket opens a list.
_BEFORE = {"SELECT", "FROM", "WHERE", "IN", "AND", "OR", "NOT", "ON", "BY", "THEN", "ELSE", "WHEN", "VALUES", "AS", "LIKE", "BETWEEN", "HAVING", "CASE"}


def _operand(parts: list[Token]) -> int:
    """Where the value that ends the parts begins: a name with dots, or a call or bracket; the length if there is none."""
    at = len(parts)
    while at:
        kind, text = parts[at - 1]
        if (kind, text) == ("mark", ")"):
            depth, at = 1, at - 1
            while depth:
                at -= 1
                depth += (parts[at] == ("mark", ")")) - (parts[at] == ("mark", "("))
            if at and parts[at - 1][0] == "word" and _word(parts[at - 1]) not in _BEFORE:
                at -= 1
        elif kind == "name" or (kind == "word" and text.upper() not in _BEFORE):
            at -= 1
        else:
            return at if at < len(parts) and (kind, text) != ("mark", ".") else len(parts)
        if at and parts[at - 1] == ("mark", "."):
            at -= 1
        else:
            return at
    return at


def _functions(parts: list[Token]) -> list[Token]:
    """Calls of functions that have another name or form in Spark, inner ones first."""
    out, k = [], 0
    while k < len(parts):
        kind, text = parts[k]
        at = _next(parts, k + 1)
        name = text.lower()
        called = kind == "word" and at < len(parts) and parts[at] == ("mark", "(")
        if called and name in _ORDERED and (by := _find(parts[at + 1 : (end := _closing(parts, at))], "ORDER")) >= 0:
            out += _ordered(name, parts[at + 1 : end], by)
            k = end + 1
            continue
        if called and not (out and out[-1] == ("mark", ".")) and (name in RENAMED or name in TEMPLATES):
            end = _closing(parts, at)
            inner = _functions(parts[at + 1 : end])
            if name in RENAMED:
                out += [("word", RENAMED[name]), ("mark", "("), *inner, ("mark", ")")]
            else:
                args = [text_of(a).strip() for a in split(inner)] if text_of(inner).strip() else []
                out += [("mark", "("), *tokens(TEMPLATES[name](*args)), ("mark", ")")]
            k = end + 1
        else:
            out.append(parts[k])
            k += 1
    return out


#: Words that end the items of an ORDER BY.
_ENDS = {"LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "FETCH", "WINDOW", ")"}


def _null_order(parts: list[Token]) -> list[Token]:
    """ORDER BY items with the order of nulls spelled out: last if ascending, first if descending."""
    out, k = [], 0
    while k < len(parts):
        by = _next(parts, k + 1)
        if _word(parts[k]) == "ORDER" and by < len(parts) and _word(parts[by]) == "BY":
            end, depth = by + 1, 0
            while end < len(parts):
                w = _word(parts[end])
                if depth == 0 and w in _ENDS:
                    break
                depth += (w == "(") - (w == ")")
                end += 1
            items = []
            for item in split(parts[by + 1 : end]):
                item = _null_order(item)
                words = {_word(t) for t in item}
                told = text_of(item).strip()
                items.append(told if "NULLS" in words or words & {"ALL"} and len(told) == 3 else f"{told} NULLS {'FIRST' if 'DESC' in words else 'LAST'}")
            out += [*parts[k : by + 1], ("space", " "), ("word", ", ".join(items)), ("space", " ")]
            k = end
        else:
            out.append(parts[k])
            k += 1
    return out


def _tail(parts: list[Token]) -> tuple[list[Token], list[Token]]:
    """A query without its last ORDER BY, LIMIT and OFFSET, and these."""
    at = _find(parts, "ORDER", "LIMIT", "OFFSET")
    return (parts, []) if at < 0 else (parts[:at], parts[at:])


def _distinct_on(parts: list[Token]) -> list[Token]:
    """SELECT DISTINCT ON (keys) ...: the first row of each key in the query's order."""
    first = _next(parts, 0)
    at = _next(parts, first + 1) if first < len(parts) else first
    on = _next(parts, at + 1) if at < len(parts) else at
    if on >= len(parts) or [_word(parts[k]) for k in (first, at, on)] != ["SELECT", "DISTINCT", "ON"]:
        return parts
    open_ = _next(parts, on + 1)
    close = _closing(parts, open_)
    keys = text_of(parts[open_ + 1 : close])
    body, tail = _tail(parts[close + 1 :])
    select, rest = body[: (source := _find(body, "FROM"))], body[source:]
    order, limit = (tail, []) if (cut := _find(tail, "LIMIT", "OFFSET")) < 0 else (tail[:cut], tail[cut:])
    over = f"row_number() OVER (PARTITION BY {keys} {text_of(order) if order else f'ORDER BY {keys}'})"
    new = f"SELECT * EXCEPT (__nth) FROM (SELECT {text_of(select)}, {over} AS __nth {text_of(rest)}) WHERE __nth = 1 {text_of(order)} {text_of(limit)}"
    return tokens(new)


def _qualify(parts: list[Token]) -> list[Token]:
    at, start = _find(parts, "QUALIFY"), _find(parts, "SELECT")
    if at < 0 or start < 0:
        return parts
    condition, tail = _tail(parts[at + 1 :])
    source = _find(parts, "FROM", start=start)
    new = f"{text_of(parts[:start])} SELECT * EXCEPT (__kept) FROM ({text_of(parts[start:source])}, ({text_of(condition)}) AS __kept {text_of(parts[source:at])}) WHERE __kept {text_of(tail)}"
    return tokens(new)


def _group_frames(parts: list[Token]) -> list[Token]:
    """OVER (... GROUPS frame) as a RANGE over the dense rank of the peer groups, which an inner query numbers."""
    start, source = _find(parts, "SELECT"), _find(parts, "FROM")
    listed = parts[start + 1 : source if source >= 0 else len(parts)]
    ranks: list[str] = []
    k = 0
    while start >= 0 and k < len(listed):
        open_ = _next(listed, k + 1)
        if _word(listed[k]) == "OVER" and open_ < len(listed) and listed[open_] == ("mark", "("):
            close = _closing(listed, open_)
            inside = listed[open_ + 1 : close]
            if (frame := _find(inside, "GROUPS")) >= 0:
                order = _find(inside, "ORDER")
                if not 0 <= order < frame:
                    raise ValueError("a GROUPS frame needs an order")
                ranks.append(f"dense_rank() OVER ({text_of(inside[:frame])}) AS __peers{len(ranks)}")
                listed[open_ : close + 1] = tokens(f"({text_of(inside[:order])} ORDER BY __peers{len(ranks) - 1} RANGE {text_of(inside[frame + 1 :])})")
        k += 1
    if not ranks:
        return parts
    end = _find(parts, "ORDER", "LIMIT", "OFFSET", "QUALIFY", start=source) if source >= 0 else -1
    body, tail = (parts[source + 1 :], []) if end < 0 else (parts[source + 1 : end], parts[end:])
    where = _find(body, "WHERE")
    relation = body if where < 0 else body[:where]
    if source < 0 or _find(body, "GROUP", "HAVING", "JOIN", ",", "UNION", "INTERSECT", "EXCEPT", "LATERAL") >= 0:
        raise ValueError("a GROUPS frame is read over one table or subquery, without GROUP BY")
    outside = [sum((t == ("mark", "(")) - (t == ("mark", ")")) for t in relation[: k + 1]) == 0 for k in range(len(relation))]
    named = [t for (kind, t), plain in zip(relation, outside) if plain and kind in ("word", "name") and t.upper() != "AS"]
    alias = named[-1] if named else "__rows"
    hidden = ", ".join(f"__peers{n}" for n in range(len(ranks)))
    items = ", ".join(f"* EXCEPT ({hidden})" if text_of(item).strip() == "*" else text_of(item) for item in split(listed))
    new = f"{text_of(parts[:start])}SELECT {items} FROM (SELECT *, {', '.join(ranks)} FROM {text_of(body)}) AS {alias} {text_of(tail)}"
    return tokens(new)


def _nested(parts: list[Token]) -> list[Token]:
    """Rewrites of whole queries, inner ones first."""
    out, k = [], 0
    while k < len(parts):
        if parts[k] == ("mark", "("):
            end = _closing(parts, k)
            out += [parts[k], *_nested(parts[k + 1 : end]), parts[end]]
            k = end + 1
        else:
            out.append(parts[k])
            k += 1
    return _group_frames(_qualify(_distinct_on(out)))


def rewrite(text: str) -> str:
    """One statement as Spark SQL."""
    return text_of(_null_order(_nested(_functions(_brackets(_similar(_names(tokens(text))))))))
