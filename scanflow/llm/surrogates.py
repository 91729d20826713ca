"""Surrogates for personal data: keyed, type-consistent, distinct.

Entities are found by kind: e-mail addresses, phone numbers, IP addresses of both versions, card numbers, account numbers (IBAN), social
security numbers, secrets after a key word or a known prefix, private key blocks, and names: after one or more forms of address, after a
listed given name, and wherever a word of a name found in the document stands again. Each is replaced by a surrogate of its own kind and format:

* the same length, punctuation, letter case, script and character classes;
* a card number that passes the checksum keeps passing it, another keeps failing it; an account number keeps country and check digits that fit;
* an address keeps its range (private, loopback, public), a phone number its country code;
* a listed given name becomes another name of the same gender and script, with the form of address kept.

For each format the surrogate is a keyed permutation of all strings of that format (a Feistel network over
their number, walked until the result is valid). A permutation maps equal entities to equal surrogates,
everywhere in the corpus, and different entities to different ones, so distinctness and coreference need no
shared table. Words of names have one permutation, whatever their place: listed names go round among those of their script and gender, all
others never become a listed one. Letter case and phone punctuation are form, not identity: variants of one entity stay variants
of one surrogate. ``collisions`` checks distinctness over a whole corpus as a grouped count.

What a list does not know cannot keep its gender: an unlisted name keeps script, length and last letter. A name without a form of
address, a listed given name or a second mention stays.

One pass without a shuffle; a text is rewritten whole.

Rows: null texts stay null; texts without entities come back unchanged. Repeated texts give equal results.
Overlapping finds: the earlier begins, then the longer, wins.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("key", "email", "iban", "phone", "ip", "card", "id", "secret", "name")

#: Alphabets within which a letter or digit is replaced.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
)
HEX = "0123456789abcdef"

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "anna clara elena emma eva ines julia laura lucia maria marta nina olga paula rosa sara sofia susan".split(),
    ("latin", "m"): "adam boris carlos daniel david felix georg hugo ivan jan john karl lucas martin oscar paul peter thomas".split(),
    ("cyrillic", "f"): "анна вера дарья елена ирина мария нина ольга софья татьяна".split(),
    ("cyrillic", "m"): "антон борис виктор денис иван игорь максим олег павел юрий".split(),
    ("greek", "f"): "άννα ελένη ειρήνη μαρία σοφία".split(),
    ("greek", "m"): "γιώργος δημήτρης κώστας νίκος πέτρος".split(),
}
#: Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Herr": "m", "Herrn": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f",
    "Señorita": "f", "Don": "m", "Doña": "f", "Sr": "m", "Sra": "f", "Signor": "m", "Signora": "f", "M.": "m", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}

_LETTER = r"[^\W\d_]"
_EMAIL = re.compile(r"(?<![\w.+-])[\w+-](?:[\w.+-]*[\w+-])?@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w@])")
_PHONE = re.compile(
    r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w])"
    r"|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])"
    r"|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
    r"|(?<![\w.+/-])0\d{1,4}[ /]\d{5,8}(?![\w-]|[./]\d)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<![^\W_])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![^\W_])")
_CARD = re.compile(
    r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{5})(?![\w]|[.-]\d)"
)
_SECRET = re.compile(
    r"(?<![^\W_])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_=.-]{12,})",
    re.I,
)
_PASSWORD = re.compile(r"(?<![^\W_])(?:passw(?:or)?d|pwd)[\"']?\s*[:=]\s*[\"']?((?=[^\s\"']*\d)[^\s\"',;]{6,})", re.I)
_PRIVATE = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
#: Public prefixes of access keys; what follows is the secret.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "sk-", "xoxa-", "xoxb-", "xoxp-", "eyJ")
_KEY = re.compile(
    r"(?<![^\W_])(?:(?:AKIA|ASIA)([A-Z0-9]{16})|AIza([\w-]{35})|gh[pousr]_([A-Za-z0-9]{30,})|glpat-([\w-]{20,})"
    r"|sk-([A-Za-z0-9_-]{20,})|xox[abp]-([A-Za-z0-9-]{10,})|eyJ([\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}))(?![\w-])"
)
_BARE_HEX = re.compile(r"(?<![^\W_])(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(?![^\W_])")
_TITLE = re.compile(
    rf"(?<![^\W_])({'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))})(?![^\W_])\.?(?=[ ]\w)"
)
_NAME_WORD = re.compile(rf"{_LETTER}+(?:[-’']{_LETTER}+)*")
_LISTED = re.compile(
    rf"(?<![^\W_])(?:{'|'.join(sorted((n[:1].upper() + n[1:] for names in GIVEN.values() for n in names), key=len, reverse=True))})(?=[ ]{_LETTER})"
)
_DIGIT = re.compile(r"\d")


def _round(key: bytes, tweak: bytes, turn: int, value: int) -> int:
    size = (value.bit_length() + 7) // 8 or 1
    data = tweak + turn.to_bytes(2, "big") + value.to_bytes(size, "big")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=64).digest(), "big")


def permute(value: int, n: int, key: bytes, tweak: bytes, rounds: int = 8) -> int:
    """Keyed permutation of 0 .. n - 1. Halves wider than 512 bits are filled by further digests."""
    if n < 2:
        return value
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(rounds):
            stream, part = _round(key, tweak, turn, right), 1
            while part * 512 < half:
                stream |= _round(key, tweak, turn + rounds * part, right) << (512 * part)
                part += 1
            left, right = right, left ^ (stream & mask)
        value = (left << half) | right
        if value < n:
            return value


def _alphabet(char: str, hexed: bool) -> str:
    if hexed and char in HEX:
        return HEX
    for alphabet in ALPHABETS:
        if char in alphabet:
            return alphabet
    return char


def scramble(text: str, key: bytes, kind: str, hexed: bool = False, fixed: int = 0) -> str:
    """Another string of the same format: every character stays in its alphabet, the first ``fixed`` stay."""
    sets = [_alphabet(c, hexed) if i >= fixed else c for i, c in enumerate(text)]
    n, value = 1, 0
    for c, s in zip(text, sets):
        value, n = value * len(s) + s.index(c), n * len(s)
    shape = "".join(s[0] for s in sets)
    value = permute(value, n, key, f"{kind}|{shape}".encode())
    out = []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    return "".join(reversed(out))


def _recased(new: str, old: str) -> str:
    """``new`` in the letter case of ``old``, character by character (or as a whole for other lengths)."""
    if len(new) == len(old):
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, old))
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def _lower(text: str) -> str:
    """Lower case, one character for one."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _refilled(pattern: str, digits: str) -> str:
    take = iter(digits)
    return "".join(next(take) if c.isdigit() else c for c in pattern)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _email(text: str, key: bytes) -> str:
    local, _, domain = _lower(text).rpartition("@")
    labels = domain.split(".")
    keep = 1 if len(labels) < 3 else 2
    host = ".".join(labels[:-keep])
    new = scramble(local, key, "local") + "@" + ".".join([scramble(host, key, "host"), *labels[-keep:]])
    return _recased(new, text)


def _phone(text: str, key: bytes) -> str:
    m = re.match(r"\+\d{1,3}(?=\D)|\+\d{2}", text)
    code = m.group() if m else ""
    rest = "".join(c for c in text[len(code) :] if c.isdigit())
    return code + _refilled(text[len(code) :], scramble(rest, key, "phone"))


def _card(text: str, key: bytes) -> str:
    digits = "".join(c for c in text if c.isdigit())
    valid = _luhn(digits)
    new = scramble(digits, key, "card")
    while _luhn(new) != valid:
        new = scramble(new, key, "card")
    return _refilled(text, new)


def _range(address: int) -> str:
    for name, net, bits in (("10", 10 << 24, 8), ("127", 127 << 24, 8), ("172", (172 << 24) | (16 << 16), 12), ("192", (192 << 24) | (168 << 16), 16)):
        if address >> (32 - bits) == net >> (32 - bits):
            return name
    return "public"


def _ip(text: str, key: bytes) -> str:
    value = int.from_bytes(bytes(int(p) for p in text.split(".")), "big")
    wanted = _range(value)
    low, n = {"10": (10 << 24, 1 << 24), "127": (127 << 24, 1 << 24), "172": ((172 << 24) | (16 << 16), 1 << 20), "192": ((192 << 24) | (168 << 16), 1 << 16)}.get(wanted, (0, 1 << 32))
    new = value
    while True:
        new = low + permute(new - low, n, key, f"ip|{wanted}".encode())
        if _range(new) == wanted:
            return ".".join(str(b) for b in new.to_bytes(4, "big"))


def _secret(text: str, key: bytes) -> str:
    lowered = _lower(text)
    hexed = all(c in HEX for c in lowered)
    return _recased(scramble(lowered, key, "secret", hexed), text)


_KNOWN = {name: (group, names) for group, names in GIVEN.items() for name in names}


def _script(word: str) -> str:
    return "cyrillic" if any("а" <= c <= "я" for c in word) else "greek" if any("α" <= c <= "ώ" for c in word) else "latin"


def _word(word: str, key: bytes) -> str:
    """Another word for a word of a name. A listed given name becomes one of the same script and gender, any other a word of the same
    letters' classes that is no listed one. The last letter, which may tell a gender, stays."""
    lowered = _lower(word)
    if lowered in _KNOWN:
        group, names = _KNOWN[lowered]
        order = sorted(names, key=lambda n: _round(key, f"given|{group}".encode(), 0, int.from_bytes(n.encode(), "big")))
        return _recased(order[(order.index(lowered) + 1) % len(order)], word)
    new = scramble(lowered[::-1], key, "name", fixed=1)[::-1]
    while new in _KNOWN:
        new = scramble(new[::-1], key, "name", fixed=1)[::-1]
    return _recased(new, word)


def _name(text: str, key: bytes) -> str:
    return " ".join(_word(w, key) for w in text.split(" "))


def _iban_fits(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban(text: str, key: bytes) -> str:
    plain = _lower(text.replace(" ", ""))
    body = scramble(plain[4:], key, f"iban|{plain[:2]}")
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    take = iter(f"{plain[:2]}{check:02d}{body}".upper())
    return "".join(next(take) if c != " " else c for c in text)


def _ip6_fits(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6 and len(text) > 4
    except ValueError:
        return False


def _ip6(text: str, key: bytes) -> str:
    """The first group, which tells the range, stays."""
    first = len(text.split(":")[0])
    return _recased(scramble(_lower(text), key, "ip6", True, fixed=first), text)


def _digits(text: str, key: bytes) -> str:
    return _refilled(text, scramble("".join(c for c in text if c.isdigit()), key, "id"))


def _key_block(text: str, key: bytes) -> str:
    m = _PRIVATE.match(text)
    lowered = _lower(m.group(2))
    return text[: m.start(2)] + _recased(scramble(lowered, key, "key"), m.group(2)) + text[m.end(2) :]


def _capital_words(text: str, at: int, most: int = 3) -> list[tuple[int, int]]:
    """Capitalised words from ``at`` on, single blanks between them; a form of address or a small word ends them."""
    out = []
    while len(out) < most:
        m = _NAME_WORD.match(text, at)
        if not m or not m.group()[:1].isupper() or m.group() in TITLES:
            break
        out.append((m.start(), m.end()))
        if text[m.end() : m.end() + 1] != " ":
            break
        at = m.end() + 1
    return out


def _names(text: str) -> list[tuple[int, int]]:
    """Names after forms of address and listed given names, then their words wherever they stand."""
    found, reach = [], 0
    for m in _TITLE.finditer(text):
        if m.group(1) == "M." and text[m.end() - 1] != ".":
            continue
        if m.start() >= reach and (words := _capital_words(text, m.end() + 1)):
            found.append((words[0][0], reach := words[-1][1]))
    for m in _LISTED.finditer(text):
        words = _capital_words(text, m.start())
        # a word that stands twice is no name
        if len(words) > 1 and text[slice(*words[0])] != text[slice(*words[1])]:
            found.append((words[0][0], words[min(len(words), 3) - 1][1]))
    known = {w for a, b in found for w in text[a:b].split(" ") if len(w) > 2}
    if known:
        again = re.compile(rf"(?<![^\W_])(?:{'|'.join(re.escape(w) for w in sorted(known, key=len, reverse=True))})(?![^\W_])")
        found += [m.span() for m in again.finditer(text)]
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the entities of a text, in order and without overlap."""
    found = []

    def add(kind: str, pattern: re.Pattern, group: int = 0, fits=None) -> None:
        found.extend((*m.span(group), kind) for m in pattern.finditer(text) if fits is None or fits(m.group(group)))

    if "@" in text:
        add("email", _EMAIL)
    if _DIGIT.search(text):
        add("phone", _PHONE)
        add("ip", _IP)
        add("id", _SSN)
        add("iban", _IBAN, fits=_iban_fits)
        add("card", _CARD)
        add("secret", _BARE_HEX)
    if any(p in text for p in KEY_PREFIXES):
        found += [(m.start(m.lastindex), m.end(m.lastindex), "secret") for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        add("secret", _SECRET, 1)
        add("secret", _PASSWORD, 1)
        add("ip", _IP6, fits=_ip6_fits)
    if "PRIVATE KEY-----" in text:
        add("key", _PRIVATE)
    found += [(a, b, "name") for a, b in _names(text)]
    found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
    out, reach = [], 0
    for f in found:
        if f[0] >= reach:
            out.append(f)
            reach = f[1]
    return out


def _address(text: str, key: bytes) -> str:
    return _ip6(text, key) if ":" in text else _ip(text, key)


_MAKERS = {
    "email": _email, "phone": _phone, "ip": _address, "card": _card, "secret": _secret, "iban": _iban, "id": _digits, "key": _key_block,
    "name": _name,
}


def surrogate(text: str, kind: str, key: bytes) -> str:
    return _MAKERS[kind](text, key)


def rewrite(text: str, key: bytes, memory: dict | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (begin, end, kind, surrogate) of each, in places of the old text."""
    memory = {} if memory is None else memory
    parts, spans, at = [], [], 0
    for begin, end, kind in find(text):
        old = text[begin:end]
        if (kind, old) not in memory:
            if len(memory) > 50_000:
                memory.clear()
            memory[kind, old] = surrogate(old, kind, key)
        new = memory[kind, old]
        parts += [text[at:begin], new]
        spans.append((begin, end, kind, new))
        at = end
    return "".join([*parts, text[at:]]), spans


_SPANS = "spans array<struct<begin:int,end:int,kind:string,surrogate:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))


def replace(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (with surrogates), n_entities and spans (code points of the old text) of every row."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            texts, spans = [], []
            for value in batch.column("text").to_pylist():
                new, found = (None, []) if value is None else rewrite(value, secret, memory)
                texts.append(new)
                spans.append([{"begin": b, "end": e, "kind": k, "surrogate": s} for b, e, k, s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(texts, type=pa.string()), pa.array([len(s) for s in spans], type=pa.int64()), pa.array(spans, type=_SPAN_TYPE)],
                names=["doc", "text", "n_entities", "spans"],
            )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    out = slim.mapInArrow(run, f"doc long, text string, n_entities long, {_SPANS}")
    return out.select(F.col("doc").alias(doc_id), F.col("text").alias(text), "n_entities", "spans")


def collisions(docs: DataFrame, replaced: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """kind and surrogate that stand for more than one entity (in lower case): empty if all is well.

    ``doc_id`` must be unique. Entities are compared by hash; their texts do not leave the tasks.
    """
    spans = replaced.where("n_entities > 0").select(doc_id, F.explode("spans").alias("s"))
    old = spans.join(docs.select(doc_id, F.col(text).alias("_old")), doc_id)
    entity = F.lower(F.substring(F.col("_old"), F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin")))
    plain = F.regexp_replace(entity, r"[ ().-]", "")
    same = F.when(F.col("s.kind").isin("phone", "card", "iban", "id"), plain).otherwise(entity)
    new = F.lower(F.col("s.surrogate"))
    given = F.when(F.col("s.kind").isin("phone", "card", "iban", "id"), F.regexp_replace(new, r"[ ().-]", "")).otherwise(new)
    return (
        old.select(F.col("s.kind").alias("kind"), given.alias("surrogate"), F.xxhash64(same).alias("entity"))
        .distinct()
        .groupBy("kind", "surrogate")
        .agg(F.count(F.lit(1)).alias("entities"))
        .where("entities > 1")
    )
