"""Python literals as JSON, by column expressions alone.

The text is cut into tokens by one pattern. A fold over the tokens keeps the open brackets, and for each whether a comma or a colon
stood in it; it tells tuples from mere parentheses, and finds sets, misplaced signs, commas and brackets, which have no JSON. Each token then
becomes its JSON from what stands beside it: adjacent strings grow together, trailing commas go, numbers and
constants before a colon are quoted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(q: str, inner: str) -> str:
    """A string between ``q``: runs of other characters, and escapes or (in triple quotes) single quotes between them."""
    other = rf"[^{q[0]}\\{inner}]*+"
    stop = rf"\\(?s:.)|{q[0]}(?!{q[:2]})" if len(q) == 3 else r"\\(?s:.)"
    return rf"{q}{other}(?:(?:{stop}){other})*+{q}"


_STRING = "[rRuU]?(?:" + "|".join(_quoted(q, i) for q, i in (("'" * 3, ""), ('"' * 3, ""), ("'", r"\n"), ('"', r"\n"))) + ")"
_NUMBER = (
    r"0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?"
)
_TOKEN = rf"\G(?:\s+|{_STRING}|(?:{_NUMBER})(?![0-9A-Za-z_.])|(?:None|True|False)(?![0-9A-Za-z_])|[\[\]{{}}(),:+-])"
_PIECE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|(?s:.))|[^\\]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex(digits: Column, base: int = 16) -> Column:
    return F.conv(digits, base, 10).cast("int")


def _unit(code: Column) -> Column:
    return F.format_string("\\u%04x", code)


def _escape(piece: Column) -> Column:
    """JSON of one piece of a string: an escape, or text without any."""
    kind, rest = F.substring(piece, 2, 1), F.substring(piece, 3, 8)
    wide = _hex(rest) - 0x10000
    pair = F.concat(_unit(F.shiftright(wide, 10) + 0xD800), _unit(wide.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    known = (
        F.when(kind.isin("n", "t", "r", "b", "f", "\\", '"'), piece)
        .when(kind == "'", F.lit("'"))
        .when(kind == "\n", F.lit(""))
        .when(kind == "a", F.lit("\\u0007"))
        .when(kind == "v", F.lit("\\u000b"))
        .when((kind == "x") & (F.length(piece) == 4), _unit(_hex(rest)))
        .when((kind == "u") & (F.length(piece) == 6), piece)
        .when((kind == "U") & (F.length(piece) == 10), F.when(wide < 0, _unit(wide + 0x10000)).otherwise(pair))
        .when(kind.rlike("[0-7]"), _unit(_hex(F.substring(piece, 2, 3), 8)))
        # an unknown escape is a backslash and its character; names, and too few digits, are errors
        .when(~kind.isin("x", "u", "U", "N"), F.concat(F.lit("\\\\"), kind))
    )
    return F.when(piece.startswith("\\"), known).otherwise(_plain(piece))


def _plain(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\f", "\\f"), ("\b", "\\b")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def _string(token: Column) -> Column:
    """Inside of a string token, as JSON has it."""
    raw, bare = token.rlike("^[rR]"), F.regexp_replace(token, "^[rRuU]", "")
    triple = bare.rlike("^(?:'''|\"\"\")")
    marks = F.when(triple, 3).otherwise(1)
    body = F.substring(bare, marks + 1, F.length(bare) - 2 * marks)
    pieces = F.transform(F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0)), _escape)
    cooked = _let(pieces, lambda ps: F.when(~F.exists(ps, lambda p: p.isNull()), F.array_join(ps, "")))
    return F.when(raw | ~body.contains("\\"), _plain(body)).otherwise(cooked)


def _number(token: Column) -> Column:
    plain = F.replace(token, F.lit("_"), F.lit(""))
    fixed = F.regexp_replace(F.regexp_replace(plain, r"^\.", "0."), r"\.(?![0-9])", ".0")
    out = fixed
    for letter, base in (("x", 16), ("o", 8), ("b", 2)):
        out = F.when(F.lower(F.substring(plain, 2, 1)) == letter, F.conv(F.substring(plain, 3, 64), base, 10)).otherwise(out)
    return out


def literal_as_json(text: Column) -> Column:
    """JSON of a Python literal; null for texts that are none, and for what JSON lacks (sets, bytes, complex numbers)."""

    def checked(cut: Column) -> Column:
        length = F.aggregate(cut, F.lit(0), lambda n, t: n + F.length(t))
        return F.when(length == F.length(text), _let(F.filter(cut, lambda t: ~t.rlike(r"^\s")), emitted))

    def emitted(tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, _let(F.transform(tokens, _kind), lambda kinds: _let(_indexed(tokens, kinds), _folded)))

    return _let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), checked)


def _kind(token: Column) -> Column:
    """``s`` string, ``n`` number, ``c`` constant, else the sign itself; null beyond the ends."""
    return (
        F.when(token.rlike("^(?:[rRuU]?['\"])"), "s").when(token.rlike(r"^[0-9.]"), "n").when(token.rlike("^[NTF]"), "c").otherwise(token)
    )


def _indexed(tokens: Column, kinds: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(
        i.alias("i"), t.alias("t"), F.get(kinds, i).alias("k"), F.when(i > 0, F.get(kinds, i - 1)).alias("before"),
        F.get(kinds, i + 1).alias("after"),
    ))


def _folded(indexed: Column) -> Column:
    begun = F.struct(
        F.lit(True).alias("valid"),
        F.array().cast("array<struct<at:int,kind:string,comma:boolean,colon:boolean>>").alias("stack"),
        F.array().cast("array<int>").alias("tuples"),
    )

    def step(state: Column, x: Column) -> Column:
        # the innermost open bracket is the last of the stack
        stack, kind, before = state["stack"], x["k"], x["before"]
        top, rest = F.get(stack, F.size(stack) - 1), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        opens, closes = kind.isin("[", "{", "("), kind.isin("]", "}", ")")
        fresh = F.struct(x["i"].alias("at"), kind.alias("kind"), F.lit(False).alias("comma"), F.lit(False).alias("colon"))
        seen = F.struct(
            top["at"].alias("at"), top["kind"].alias("kind"), (top["comma"] | (kind == ",")).alias("comma"),
            (top["colon"] | (kind == ":")).alias("colon"),
        )
        now = (
            F.when(opens, F.concat(stack, F.array(fresh))).when(closes, rest)
            .when(kind.isin(",", ":") & (F.size(stack) > 0), F.concat(rest, F.array(seen))).otherwise(stack)
        )
        empty = top["at"] == x["i"] - 1
        is_tuple = (kind == ")") & (top["comma"] | empty)
        after_value = before.isin("s", "n", "c", "]", "}", ")")
        fits = (
            F.when(kind == "]", top["kind"] == "[").when(kind == ")", top["kind"] == "(")
            .when(kind == "}", (top["kind"] == "{") & (top["colon"] | empty))
            .when(kind == ",", after_value & top["kind"].isNotNull())
            .when(kind == ":", before.isin("s", "n", "c") & (top["kind"] == "{"))
            .when(kind.isin("+", "-"), ~after_value & ~before.isin("+", "-") & (x["after"] == "n"))
            .when(kind == "s", ~after_value | (before == "s"))
            .otherwise(~after_value)
        )
        # the first token has none before it
        valid = F.coalesce(fits, F.when(before.isNull(), ~closes & ~kind.isin(",", ":")), F.lit(False))
        pairs = F.when(is_tuple, F.concat(state["tuples"], F.array(top["at"], x["i"]))).otherwise(state["tuples"])
        return F.struct((state["valid"] & valid).alias("valid"), now.alias("stack"), pairs.alias("tuples"))

    def closed(end: Column) -> Column:
        return F.when(end["valid"] & (F.size(end["stack"]) == 0), _joined(indexed, end["tuples"]))

    return _let(F.aggregate(indexed, begun, step), closed)


def _joined(indexed: Column, tuples: Column) -> Column:
    def out(x: Column) -> Column:
        token, kind, after = x["t"], x["k"], x["after"]
        key = F.coalesce(after == ":", F.lit(False))
        constant = F.when(token == "None", "null").when(token == "True", "true").otherwise("false")
        word = F.when(kind == "n", _number(token)).otherwise(constant)
        grown = F.coalesce(x["before"] == "s", F.lit(False)), F.coalesce(after == "s", F.lit(False))
        text = F.concat(F.when(grown[0], "").otherwise('"'), _string(token), F.when(grown[1], "").otherwise('"'))
        signed = F.coalesce(x["before"].isin("+", "-"), F.lit(False))
        paired = F.array_contains(tuples, x["i"])
        return (
            F.when(kind == "s", text)
            .when(kind.isin("n", "c") & key, F.concat(F.lit('"'), word, F.lit('"')))
            .when(kind.isin("n", "c"), F.concat(F.when(signed, "").otherwise(" "), word))
            .when(kind == "+", F.lit(""))
            .when(kind == "(", F.when(paired, "[").otherwise(""))
            .when(kind == ")", F.when(paired, "]").otherwise(""))
            .when((kind == ",") & F.coalesce(after.isin("]", "}", ")"), F.lit(False)), F.lit(""))
            .otherwise(token)
        )

    return _let(F.transform(indexed, out), lambda parts: F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "")))
