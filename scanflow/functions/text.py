"""Names, options, answers and scores as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.functions.literals import literal_as_json

# Keyword lists the results depend on.
HUMAN_WORDS = [
    "hand", "hands", "finger", "fingers", "arm", "arms", "foot", "feet",
    "leg", "legs", "body", "face", "head", "person",
]
FURNITURE_WORDS = [
    "counter", "cabinet", "microwave", "refrigerator", "oven", "stove", "sink", "wall",
    "floor", "ceiling", "curtain", "countertop", "furniture", "shelf", "drawer",
]
GENERIC_WORDS = [
    "counter", "sink", "cabinet", "stove", "table", "floor", "wall", "ceiling", "curtain",
    "countertop", "outlet", "window", "furniture", "shelf", "drawer", "rack", "gas_stove",
]
AMBIGUOUS_WORDS = [
    "plastic", "paper", "cloth", "fabric", "material", "container", "bag", "box", "case",
    "package", "wrapper", "thing", "item", "stuff", "object", "device", "tool", "equipment",
]
STOP_WORDS = ["the", "a", "an", "of", "in", "on", "at", "and", "or"]
MODIFIER_WORDS = [
    "red", "blue", "green", "yellow", "black", "white", "brown",
    "big", "small", "large", "tiny", "old", "new", "clean", "dirty",
]
SUBJECTIVE_ATTRIBUTES = ["usage", "position", "size"]
CONFUSING_PAIRS = {
    "color": [
        ("red", "pink"), ("red", "dark red"), ("blue", "light blue"), ("blue", "dark blue"),
        ("white", "silver"), ("white", "light gray"), ("black", "dark gray"), ("black", "dark"),
        ("brown", "tan"), ("brown", "dark brown"), ("green", "dark green"), ("green", "lime"),
    ],
    "material": [
        ("metal", "metallic"), ("wood", "wooden"), ("plastic", "synthetic"), ("glass", "transparent"),
    ],
    "texture": [
        ("smooth", "glossy"), ("smooth", "polished"), ("rough", "coarse"), ("rough", "textured"),
    ],
}
SINGULAR_PLURAL = [
    ("counter", "countertop"), ("tomato", "tomatoes"), ("onion", "onions"),
    ("pepper", "peppers"), ("knife", "knives"), ("plate", "plates"), ("bowl", "bowls"),
    ("spoon", "spoons"), ("fork", "forks"), ("cup", "cups"),
]
FALLBACK_OBJECTS = [
    "spoon", "fork", "knife", "cup", "mug", "plate", "bowl", "pan", "pot", "kettle", "microwave",
    "refrigerator", "toaster", "cutting board", "sink", "towel", "jar", "bottle",
]
TASK_ROUTES = [
    ("future_action", ["future_action", "action_prediction"]),
    ("future_remind_hard", ["remind_hard"]),
    ("future_remind_easy", ["remind_easy", "gaze_triggered"]),
    ("present_attr", ["present_attr", "attribute_recognition"]),
    ("present_ident", ["present_ident", "identification"]),
    ("past_next_after_group", ["next_after_group", "gaze_sequence"]),
    ("past_scene_reconstruction", ["scene_reconstruction", "scene_recall"]),
    ("past_transition_pattern", ["transition_pattern", "object_transition"]),
]


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_word(text: Column, values: list[str]) -> Column:
    """Whether any of ``values`` occurs in ``text`` as a substring."""
    return F.lower(text).rlike("|".join(values))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def light_norm(text: Column) -> Column:
    """NFKC, trimmed, blanks collapsed. The Python function is handed null for plain ASCII text."""
    value = F.coalesce(text, F.lit(""))
    plain = F.coalesce(nfkc(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def norm_name(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("_"), F.lit(" "))


def option_value(option: Column) -> Column:
    """Text after the first ``". "``."""
    at = F.locate(". ", option)
    return F.when(at > 0, F.substr(option, at + 2)).otherwise(option)


def option_letter(option: Column) -> Column:
    return F.when(option.contains(". "), F.substring_index(option, ". ", 1)).otherwise(F.lit(""))


def is_human(text: Column) -> Column:
    return any_word(text, HUMAN_WORDS)


def is_furniture(text: Column) -> Column:
    return any_word(text, FURNITURE_WORDS)


def is_generic_context(objects: Column) -> Column:
    """No context, or every object names a fixture."""
    return F.coalesce(F.size(objects) <= 0, F.lit(True)) | F.forall(objects, lambda o: any_word(o, GENERIC_WORDS))


def context_leaks(objects: Column, answer: Column) -> Column:
    """Whether a word longer than three letters of any object occurs in the answer."""
    pieces = F.flatten(
        F.transform(objects, lambda o: F.split(F.trim(F.regexp_replace(F.lower(o), r"[0-9\-_]", " ")), r"\s+"))
    )
    return F.exists(pieces, lambda w: (F.length(w) > 3) & F.lower(answer).contains(w))


def is_ambiguous(name: Column) -> Column:
    return F.lower(name).isin(AMBIGUOUS_WORDS + [w + "s" for w in AMBIGUOUS_WORDS])


def name_words(name: Column) -> Column:
    """Distinct words of a name without stop words."""
    pieces = F.filter(F.split(norm_name(name), r"\s+"), lambda w: w != "")
    return F.array_except(F.array_distinct(pieces), words(STOP_WORDS))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over all words of two names, 0 when neither has a word."""
    return _shared_ratio(name_words(a), name_words(b))


def _shared_ratio(wa: Column, wb: Column) -> Column:
    union = F.size(F.array_union(wa, wb))
    return F.when(union > 0, F.size(F.array_intersect(wa, wb)) / F.when(union > 0, union)).otherwise(F.lit(0.0))


def similar_names(
    a: Column, b: Column, strict: bool = True, wa: Column | None = None, wb: Column | None = None
) -> Column:
    """Whether two option names are too close to tell apart; ``wa`` and ``wb`` are their words when known."""
    wa = name_words(a) if wa is None else wa
    wb = name_words(b) if wb is None else wb
    partial = F.lit(True)
    if strict:
        beyond_modifiers = F.size(F.array_except(F.array_intersect(wa, wb), words(MODIFIER_WORDS))) > 0
        partial = beyond_modifiers & (_shared_ratio(wa, wb) >= 0.5)
    return (
        F.when(~F.arrays_overlap(wa, wb), F.lit(False))
        .when((a == b) | a.contains(b) | b.contains(a), F.lit(True))
        .otherwise(partial)
    )


def confusing_pairs(values: Column, kind: Column) -> Column:
    """Pairs of the attribute kind whose members are both among ``values``."""
    table = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(a).alias("first"), F.lit(b).alias("second"))
            for k, pairs in CONFUSING_PAIRS.items()
            for a, b in pairs
        ]
    )
    return F.filter(
        table,
        lambda p: (p["kind"] == kind) & F.array_contains(values, p["first"]) & F.array_contains(values, p["second"]),
    )


def needs_polish(options: Column) -> Column:
    """Whether an option is over 200 characters, or over 100 without an end mark."""
    return F.exists(
        options,
        lambda o: (F.length(o) > 200) | ((F.length(o) > 100) & ~F.trim(o).rlike(r"[.!?,;]$")),
    )


def strip_fences(text: Column) -> Column:
    """Model output without a surrounding code fence."""
    bare = F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*```$", ""))


def fenced_json(text: Column, schema: str) -> Column:
    """Parsed model output; null when it is not JSON of the schema."""
    bare = strip_fences(text)
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, schema))


#: What a Python literal can hold beyond JSON with single quotes and Python's constants: tuples, escapes, trailing commas, neighbouring and
#: triple-quoted strings, keys that are no strings, and numbers in forms that JSON lacks.
_RICH = (
    r"[(\\]|,\s*[\]}]|['\"]\s*['\"][^,:\]}\s]|'{3}|[:\[,]\s*[+.rRuU]|\b0[xXoObB]|[0-9](?:_|\.(?![0-9]))|(?:None|True|False|[{,]\s*[0-9.]+)\s*:"
)


def _json_constants(text: Column) -> Column:
    """``text`` with Python's constants outside strings as JSON has them."""
    skip = r"""[^'"NTF]++|'[^']*+'|"[^"]*+\""""
    names = {"None": "null", "True": "true", "False": "false"}
    for name, json in names.items():
        others = "|".join(n for n in names if n != name)
        text = F.regexp_replace(text, rf"\G((?:{skip}|(?:{others}|null|true|false)\b)*+){name}\b", f"$1{json}")
    return text


def parse_literal(text: Column, schema: str) -> Column:
    """JSON or Python-literal text as typed data, null when it is neither.

    Most values are JSON but for single quotes, which the parser allows; only the others are rewritten first.
    """
    repaired = F.when(text.rlike(_RICH), literal_as_json(text)).when(text.rlike(r"\b(?:None|True|False)\b"), _json_constants(text))
    return F.from_json(F.coalesce(repaired, text), schema, {"allowSingleQuotes": "true"})


def answer_letter(text: Column) -> Column:
    """First stand-alone A-D, else the whole upper-cased text; '' for null."""
    up = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    letter = F.regexp_extract(up, r"\b([ABCD])\b", 1)
    return F.when(letter != "", letter).otherwise(up)


def yes_no(text: Column) -> Column:
    """1, 0 or -1: the reply starts with yes/no, or has it in its first 50 characters."""
    low = F.lower(F.trim(text))
    near = F.substring(low, 1, 50)
    return (
        F.when(low.startswith("yes"), 1).when(low.startswith("no"), 0)
        .when(near.contains("yes"), 1).when(near.contains("no"), 0).otherwise(-1)
    )


def text_score(predicted: Column, truth: Column, method: str = "exact_match") -> Column:
    p, t = F.lower(predicted), F.lower(truth)
    if method == "exact_match":
        hit = F.trim(p) == F.trim(t)
    elif method == "contains":
        hit = p.contains(t)
    elif method == "first_char":
        a, b = F.substring(F.trim(p), 1, 1), F.substring(F.trim(t), 1, 1)
        hit = (a != "") & (a == b)
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def weighted_score(timing: Column, text: Column, timing_weight: float = 0.5, text_weight: float = 0.5) -> Column:
    if abs(timing_weight + text_weight - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    return timing * F.lit(timing_weight) + text * F.lit(text_weight)


def in_window(t: Column, start: Column, end: Column, margin: float = 3.0) -> Column:
    return t.between(start, end + F.lit(margin))


def task_from_name(name: Column) -> Column:
    """First matching task of the ordered routes; null when nothing matches."""
    low = F.lower(name)
    out = None
    for task, keys in TASK_ROUTES:
        hit = F.lit(False)
        for key in keys:
            hit = hit | low.contains(key)
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out


def caption_from_attributes(verb: Column, noun: Column) -> Column:
    """``verb noun`` with missing parts and ``none`` left out; null when both are."""

    def known(part: Column) -> Column:
        return F.when((part != "") & (part != "none"), part)

    joined = F.concat_ws(" ", known(verb), known(noun))
    return F.when(joined != "", joined)


def object_or_caption(identity: Column, caption: Column) -> Column:
    return F.coalesce(F.nullif(identity, F.lit("")), F.nullif(caption, F.lit("")), F.lit(""))


def gaze_video_path(path: Column) -> Column:
    return F.replace(path, F.lit("/videos/"), F.lit("/gaze_visualization/"))


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def seq_text(groups: Column) -> Column:
    """``{a,b}>{c}``."""
    return F.array_join(F.transform(groups, lambda g: F.concat(F.lit("{"), F.array_join(g, ","), F.lit("}"))), ">")


def distinct_ci(items: Column) -> Column:
    """Trimmed items, the first spelling of each lower-cased key, blanks dropped."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


ATTRIBUTE_SCHEMA = T.StructType(
    [
        T.StructField("attribute_type", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("distractors", T.ArrayType(T.StringType())),
    ]
)
