"""Personal data replaced by surrogates (DataFrame functions only).

Mentions of e-mail addresses, telephone, card and identity numbers, bank accounts, IP addresses
and names after a title or a cue (`my name is`, `Name:`, `Dear`) are found with regular expressions; in
a document, so are later and earlier mentions, without either, of the names that it has with one. Each
distinct entity of the corpus (its canonical form, so that all its mentions agree) gets one
replacement from a keyed digest: the same kind of characters in the same places, the same script,
names of the gender that the title tells, card numbers that keep their check digit valid. Entities
that would share a replacement, or get one that is itself a real entity, are drawn anew with a counter;
from the draw WIDEN on, each draw adds a character (a digit, a letter, a syllable), so that
forms of which there are too few, such as all one-letter addresses of one host, never run out.
The mentions are then rendered in their own format and put back. An address without any letter or digit to
replace gets letters in the places of its signs.

Entities are combined before the shuffle. Those with more mentions than a partition holds on average are
fewer than partitions and join by broadcast; a document's mentions meet in its own row only.

Defined cases: a null text stays null, empty stays empty, texts without mentions stay as they are; rows of
equal id and text get equal results; a null id is one of its own; further columns are ignored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise, partitions, table

#: Where the query looks for its key, and the key of the test tables. Real text needs a secret of its own.
KEY_SETTING, TEST_KEY = "spark.tracespark.surrogates.key", "test tables"
#: An entity with fewer mentions than this is never joined by broadcast.
HOT_LEAST = 1000
#: The draw from which on replacements grow longer.
WIDEN = 4
# Titles by the gender they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Sir", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Signora", "Lady", "г-жа")
NEUTRAL = ("Mx", "Dr", "Prof", "Professor", "Doctor", "Docteur", "Doktor", "Rev", "Reverend", "Capt", "Sgt", "Lt", "д-р", "Д-р", "доктор", "проф", "Проф")
# What announces a name that has no title.
CUES = ("my name is", "My name is", "name is", "Name:", "name:", "Dear", "Attn:", "Signed:", "signed:", "Contact:", "Sincerely,", "Best regards,", "Kind regards,", "Ich heiße", "ich heiße", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Меня зовут", "меня зовут")
TITLE = rf"(?:(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL + CUES, key=len, reverse=True))})\.?[\x20\u00A0]++)++"
# Words that join the parts of a name (kept), and what follows a name (kept).
PARTICLES = "af al av ben bin bint da das de degli dei del della delle den der des di do dos du e el het ibn la las le les los te ten ter van vom von y zu zum zur".split()
SUFFIX = r"(?:Jr|Sr|II|III|IV|Esq)(?![\p{L}\p{M}])"
#: No word of a name starts a title, an e-mail address or a code with digits.
APART = rf"(?!{TITLE}|[\p{{L}}\p{{M}}\p{{N}}._%+-]++@|\p{{L}}++\p{{N}})"
#: One part of a name: inner capitals and apostrophes belong to it, the possessive 's does not.
PART = rf"{APART}(?:[dl]['’])?\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’](?!s(?![\p{{L}}\p{{M}}])){APART}\p{{L}}[\p{{L}}\p{{M}}]*+)*+"
PARTICLE = rf"(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})"
WORD = rf"(?:{PARTICLE}-)?{PART}(?:-(?:{PARTICLE}-)*+{PART})*+"
INITIALS = rf"{APART}\p{{Lu}}\.(?:[\x20\u00A0]?-?\p{{Lu}}\.)*+"
#: Name words after each other; a single capital without a full stop only before another word.
NAME = rf"(?:{PARTICLE}[\x20\u00A0]++)*+(?:{INITIALS}|{WORD})(?:[\x20\u00A0]*+(?<=[.\x20\u00A0])(?!{SUFFIX})(?:{PARTICLE}[\x20\u00A0]++)*+(?:{INITIALS}|(?!\p{{Lu}}(?![\p{{L}}\p{{M}}'’-]|[\x20\u00A0]++\p{{Lu}})){WORD}))*+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "ip": r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\d]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,4}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\p{L}\p{N}:]|\.\d)",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "card": r"(?<![\p{L}\d.+-])(?:(?:\d{4}[\x20-]?){3}\d{4}|3\d{3}[\x20-]?\d{6}[\x20-]?\d{5})(?![\p{L}\d]|-\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)",
    "phone": r"(?<![\p{L}\d(.+-])(?:(?:\+\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]\d{3,4}|\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,4}|\d{3}[\x20.-]\d{3}[\x20.-]\d{4})(?![\p{L}\d]|-\d)",
    "name": rf"(?<!\p{{L}}){TITLE}{NAME}",
}
#: What name_parts and render_name take apart.
PARTS = r"[\p{L}\p{M}'’]+"
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The same, and name words without title.
RUNS = rf"{ANY}|(?<![\p{{L}}\p{{M}}\p{{N}}]){NAME}"
#: Words that, without title, are taken for themselves even where a name is spelt so.
COMMON = "a after all an and as at but by for from he her his how i if in is it its my no not of on or our she so that the their then there these they this those to was we what when where which while who will with you your".split()
# The characters that stand for each other.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEXADECIMAL = ("0123456789abcdef",)
#: Letters and digits to a page of code points.
PAGE = 128


def pages() -> tuple[tuple[tuple[str, str], ...], tuple[tuple[int, int], ...]]:
    """The other letters and digits: alphabets of one page and case as (members, those to draw from), and
    ranges of code points whose pages hold letters without case only."""
    of: dict = {}
    for p in range(0x110000 // PAGE):
        for c in map(chr, range(p * PAGE, (p + 1) * PAGE)):
            kind = unicodedata.category(c)
            if kind[0] in "LN":
                of.setdefault(p, {}).setdefault("N" if kind[0] == "N" else {"Ll": "l", "Lu": "u", "Lt": "u"}.get(kind, "o"), []).append(c)
    full = [p for p in of if len(of[p].get("o", ())) == PAGE]
    ranges: list = []
    for p in full:
        if ranges and ranges[-1][1] == p:
            ranges[-1][1] = p + 1
        else:
            ranges.append([p, p + 1])
    small, known = [], set("".join(ALPHABETS))
    for p in sorted(of.keys() - set(full)):
        whole = [c for cs in of[p].values() for c in cs]
        for cs in of[p].values():
            # Case must turn one letter into one, and back; few letters draw from all of their page.
            steady = lambda cs: [c for c in cs if len(c.upper()) == len(c.lower()) == 1 and c.upper().lower() == c.lower() and (c.lower() == c) == (cs[0].lower() == cs[0])]
            targets = next(t for t in (steady(cs), steady(whole), [*cs, *ALPHABETS[0]]) if len(t) > 3)
            if members := [c for c in cs if c not in known]:
                small.append(("".join(members), "".join(targets)))
    return tuple(small), tuple((a * PAGE, b * PAGE) for a, b in ranges)


OTHERS, RANGES = pages()
# Names to draw from, by gender and script.
NAMES = {
    ("m", "latin"): "Adam Albert Brian Carl Daniel David Edward Felix George Henry Hugo James Leon Marco Martin Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Anna Carla Clara Diana Elena Emma Eva Flora Helen Ida Irene Julia Laura Lucy Maria Nina Olivia Paula Rosa Sarah Vera".split(),
    ("n", "latin"): "Alex Ariel Casey Charlie Drew Jamie Jordan Kim Morgan Quincy Robin Sasha Skyler Taylor".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Денис Иван Игорь Кирилл Максим Николай Олег Павел Роман Сергей".split(),
    ("f", "cyrillic"): "Алла Анна Вера Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Софья Юлия".split(),
    ("n", "cyrillic"): "Валя Женя Саша Слава Шура".split(),
}
SURNAMES = {
    "latin": "Adler Baker Barlow Bennett Carver Dalton Ellis Fischer Garner Hartley Keller Lambert Marlow Norton Osborne Parker Quinn Reeves Sutton Turner Vance Weller".split(),
    "cyrillic": "Белов Воронин Горин Денисов Ершов Жуков Зимин Козлов Лебедев Морозов Носов Орлов Попов Соколов".split(),
}
#: Syllables that follow when the lists are used up.
SYLLABLES = {"latin": "ba be bo da do fa ga ka la le lo ma mo na ne ra".split(), "cyrillic": "ба бе бо да до фа га ка ла ле ло ма мо на не ра".split()}


def digest(*parts) -> Column:
    """256 hexadecimal digits that depend on the key and the parts."""
    whole = F.concat_ws("\x1f", *parts)
    return F.concat(F.sha2(F.concat(whole, F.lit("\x1f0")), 512), F.sha2(F.concat(whole, F.lit("\x1f1")), 512))


def number(hexes: Column, i) -> Column:
    """The i-th byte of a digest."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(hexes, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def other_letter(c: Column, h: Column) -> Column:
    """Another letter or digit of the page of code points for one outside ALPHABETS."""
    code = F.ascii(c)
    within = code - code % PAGE + (code % PAGE + 1 + h % (PAGE - 1)) % PAGE
    paged = F.decode(F.unhex(F.lpad(F.hex(within), 8, "0")), "UTF-32")
    members, all_draws = (F.split(F.lit("\x1f".join(side)), "\x1f") for side in zip(*OTHERS, strict=True))
    draws = F.get(all_draws, F.array_position(F.transform(members, lambda a: F.contains(a, c)), True) - 1)
    at, n = F.instr(draws, c), F.length(draws)
    in_range = F.lit(False)
    for a, b in RANGES:
        in_range = in_range | ((code >= a) & (code < b))
    return F.when(in_range, paged).otherwise(F.coalesce(F.substring(draws, (at + h % (n - 1)) % n + 1, F.lit(1)), c))


def like(text: Column, hexes: Column, every: bool = False, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """Each letter and digit replaced by another of its own alphabet; all else stays. Unless every, so
    do letters and digits outside the alphabets."""

    def one(c, i):
        out = F.when(c.rlike(r"[\p{L}\p{N}]"), other_letter(c, number(hexes, i))).otherwise(c) if every else c
        for a in reversed(alphabets):
            out = F.when(F.contains(F.lit(a), c), F.substring(F.lit(a), (F.instr(F.lit(a), c) + number(hexes, i) % (len(a) - 1)) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(digits: Column) -> Column:
    """The check sum modulo 10 of a number's digits."""
    twice = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10


def card(value: Column, hexes: Column, more: Column) -> Column:
    """The first digit stays; the last makes a valid number of a valid one."""
    body = F.concat(F.substring(value, F.lit(1), F.lit(1)), like(F.substring(value, F.lit(2), F.length(value) - 2), hexes), more)
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    return F.concat(body, F.when(luhn(value) == 0, check).otherwise((check + 1 + number(hexes, 120) % 9) % 10).cast("string"))


def spelt(alphabet, hexes: Column, n: Column) -> Column:
    """n members of an alphabet."""
    of = F.array(*map(F.lit, alphabet))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(of, number(hexes, i) % len(alphabet))), "")).otherwise("")


def replacement(key: str) -> Column:
    """From (kind, value, draw) of an entity."""
    kind, value, draw = F.col("kind"), F.col("value"), F.col("draw").cast("string")
    hexes = digest(F.lit(key), kind, value, draw)
    longer = lambda alphabet: spelt(alphabet, digest(F.lit(key), F.lit("more"), kind, value, draw), F.col("draw") - WIDEN)
    letters, digits = longer(ALPHABETS[0]), longer(ALPHABETS[2])
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    other_local = F.when(local.rlike(r"[\p{L}\p{N}]"), like(local, hexes, every=True)).otherwise(spelt(ALPHABETS[0], hexes, F.length(local)))
    email = F.concat(other_local, letters, F.lit("@"), like(host, digest(F.lit(key), F.lit("host"), domain)), top)
    kept = F.greatest(F.length(value) - 10, F.lit(0))
    phone = F.concat(F.substring(value, F.lit(1), kept), like(F.substring(value, kept + 1, F.length(value)), hexes), digits)
    ip = F.concat(F.concat_ws(".", *[(number(hexes, i) % 254 + 1).cast("string") for i in range(4)]), digits)
    iban = F.concat(F.substring(value, F.lit(1), F.lit(2)), like(F.substring(value, F.lit(3), F.length(value)), hexes), digits)

    def name(lists, script):
        drawn = F.get(F.array(*[F.lit(x.lower()) for x in lists]), number(hexes, 0) % len(lists))
        return F.concat(drawn, F.when(F.col("draw") == 0, "").otherwise(spelt(SYLLABLES[script], hexes, F.col("draw") + 2)))

    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card(value, hexes, digits)).when(kind == "ip", ip).when(kind == "iban", iban)
    out = out.when(kind == "ssn", F.concat(like(value, hexes), digits)).when(kind == "ip6", F.concat(like(value, hexes, alphabets=HEXADECIMAL), digits))
    out = out.when(kind == "initial", like(value, digest(F.lit(key), kind), every=True))  # one step for all: never two to one
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    for script, of in (("cyrillic", cyrillic), ("latin", ~cyrillic)):
        out = out.when((kind == "surname") & of, name(SURNAMES[script], script))
        out = out.when((kind == "surname_f") & of, F.concat(name(SURNAMES[script], script), F.lit("а")))
        for gender in "mfn":
            out = out.when((kind == f"given_{gender}") & of, name(NAMES[gender, script], script))
    return out


def kind_of(m: Column) -> Column:
    """The kind of a mention that one of the patterns found."""
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ip6")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d") & F.length(F.regexp_replace(m, r"\D", "")).isin(15, 16), "card")
        .otherwise("phone")
    )


def name_parts(m: Column) -> Column:
    """The parts of a titled name, in order: (kind, canonical value), of no kind where they stay."""
    title, name = F.regexp_extract(m, f"^({TITLE})", 1), F.regexp_replace(m, f"^{TITLE}", "")
    female = title.rlike(rf"(?:^|[\x20\u00A0])(?:{'|'.join(FEMALE)})[.\x20\u00A0]")
    male = title.rlike(rf"(?:^|[\x20\u00A0])(?:{'|'.join(MALE)})[.\x20\u00A0]")
    given = F.when(female, "given_f").when(male, "given_m").otherwise("given_n")
    feminine = female | (~male & m.rlike(r"(?:[оеё]ва|ина|ая)$"))
    family = F.when(feminine & m.rlike(r"\p{IsCyrillic}"), "surname_f").otherwise("surname")
    words = F.split(name, r"[\x20\u00A0]+")
    whole = lambda w: w.rlike(r"[\p{L}\p{M}'’]{2}") & ~w.isin(PARTICLES)
    last = F.coalesce(F.array_max(F.transform(words, lambda w, k: F.when(whole(w), k))), F.lit(-1))
    joined = F.coalesce(F.array_min(F.transform(words, lambda w, k: F.when(w.isin(PARTICLES), k))), last)

    def one(part, k):
        kind = F.when(part.isin(PARTICLES), F.lit(None)).when(F.length(part) == 1, "initial").when((k == last) | (k > joined), family).otherwise(given)
        return F.struct(kind.alias("kind"), F.lower(part).alias("value"))

    return F.flatten(F.transform(words, lambda w, k: F.transform(F.regexp_extract_all(w, F.lit(PARTS), F.lit(0)), lambda part: one(part, k))))


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def titled(m: Column) -> Column:
    return m.rlike(f"^{TITLE}")


def bare_parts(m: Column, names: Column) -> Column:
    """The parts of name words without title, in order: (kind, canonical value), of no kind where they stay.
    names: those of the document's titled names."""

    def one(part, w):
        of = F.filter(names, lambda n: (n["value"] == F.lower(part)) & (n["kind"] != "initial"))
        kind = F.when(~F.lower(part).isin(COMMON), F.array_max(of["kind"]))
        return F.struct(kind.alias("kind"), F.lower(part).alias("value"), w.rlike(r"^\p{Lu}\.").alias("dotted"))

    parts = F.flatten(F.transform(F.split(m, r"[\x20\u00A0]+"), lambda w: F.transform(F.regexp_extract_all(w, F.lit(PARTS), F.lit(0)), lambda part: one(part, w))))
    known = lambda p: p["kind"].isNotNull()
    letter = lambda p: F.when(p["dotted"] & (F.length(p["value"]) == 1), "initial")
    with_initials = lambda ps: F.transform(ps, lambda p: F.struct(F.when(F.exists(ps, known), F.coalesce(p["kind"], letter(p))).alias("kind"), p["value"].alias("value")))
    return let(parts, with_initials)


def settled(parts: Column, names: Column) -> Column:
    """Given names whose title tells no gender take it from another title in the document."""

    def one(p):
        told = F.array_max(F.filter(names, lambda n: (n["value"] == p["value"]) & n["kind"].isin("given_f", "given_m"))["kind"])
        return F.struct(F.when(p["kind"] == "given_n", F.coalesce(told, p["kind"])).otherwise(p["kind"]).alias("kind"), p["value"].alias("value"))

    return F.transform(parts, one)


def mentions_of(text: Column) -> Column:
    """The mentions of a text in order: (i, m, is, parts). Only texts with titled names are searched again."""
    found = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda ms: F.when(F.exists(ms, titled), F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).otherwise(ms))

    def one(m, i, names):
        kind = kind_of(m)
        parts = F.when(titled(m), settled(name_parts(m), names)).when(kind == "name", bare_parts(m, names)).otherwise(entities_of(kind, m))
        return F.struct(i.alias("i"), m.alias("m"), kind.alias("is"), parts.alias("parts"))

    names = lambda ms: F.array_distinct(F.flatten(F.transform(F.filter(ms, titled), name_parts)))
    return let(found, lambda ms: let(let(names(ms), lambda ns: settled(ns, ns)), lambda ns: F.transform(ms, lambda m, i: one(m, i, ns))))


def entities_of(kind: Column, m: Column) -> Column:
    """The entities of a mention, in order: (kind, canonical value)."""
    one = lambda k, v: F.array(F.struct(k.alias("kind"), v.alias("value")))
    return (
        F.when(kind == "name", name_parts(m))
        .when(kind == "email", one(kind, F.lower(F.replace(m, F.lit("İ"), F.lit("i")))))  # lower("İ") has two characters
        .when(kind == "ip", one(kind, m))
        .when(kind == "ip6", one(kind, F.lower(m)))
        .when(kind == "iban", one(kind, F.replace(m, F.lit(" "), F.lit(""))))
        .otherwise(one(kind, F.regexp_replace(m, r"\D", "")))
    )


def render_name(m: Column, parts: Column) -> Column:
    """A name with its parts (j, other) replaced, between what separates them."""
    title, name = F.regexp_extract(m, f"^({TITLE})", 1), F.regexp_replace(m, f"^{TITLE}", "")
    words = F.regexp_extract_all(name, F.lit(PARTS), F.lit(0))

    def one(between, j):
        word, other = F.get(words, j), F.get(F.filter(parts, lambda p: p["j"] == j)["other"], F.lit(0))
        capitals = (F.length(word) > 1) & (word == F.upper(word))
        return F.concat(between, F.coalesce(F.when(capitals, F.upper(other)).otherwise(F.initcap(other)), word, F.lit("")))

    return F.concat(title, F.array_join(F.transform(F.split(name, PARTS, -1), one), ""))


def render(kind: Column, m: Column, parts: Column) -> Column:
    """A mention with its entities (j, other) replaced, in its own format."""
    value = F.get(parts["other"], F.lit(0))
    rest = lambda n: F.substring(value, n + 1, F.length(value))  # noqa: E731  what a longer replacement adds
    at = F.instr(m, "@")
    digit = lambda c, i: F.when(c.rlike(r"\d"), F.substring(value, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)
    cased = lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(value, i + 1, F.lit(1)))).otherwise(F.substring(value, i + 1, F.lit(1)))
    spaced = lambda c, i: F.when(c == " ", c).otherwise(F.substring(value, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))
    chars = F.split(m, "")
    n_digits, n_solid = F.length(F.regexp_replace(m, r"\D", "")), F.length(F.replace(m, F.lit(" "), F.lit("")))
    local, tail = F.slice(chars, F.lit(1), at - 1), F.slice(chars, at, F.size(chars))
    host = F.substring(value, F.instr(value, "@"), F.length(value))
    of_host = lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(host, i + 1, F.lit(1)))).otherwise(F.substring(host, i + 1, F.lit(1)))
    widened = F.substring(value, at, F.instr(value, "@") - at)
    return (
        F.when(kind == "name", render_name(m, parts))
        .when(kind == "email", F.concat(F.array_join(F.transform(local, cased), ""), widened, F.array_join(F.transform(tail, of_host), "")))
        .when(kind == "ip", value)
        .when(kind == "ip6", F.concat(F.array_join(F.transform(chars, cased), ""), rest(F.length(m))))
        .when(kind == "iban", F.concat(F.array_join(F.transform(chars, spaced), ""), rest(n_solid)))
        .otherwise(F.concat(F.array_join(F.transform(chars, digit), ""), rest(n_digits)))
    )


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, n) of distinct entities to (kind, value, n, draw, other), where no two entities of a
    kind share a replacement and none gets the value of another. It ends for any table: a clash is
    drawn anew, and from the draw WIDEN on forms grow without bound."""
    drawing = replacement(key)
    drawn = materialise(entities.withColumn("draw", F.lit(0)).withColumn("other", drawing))
    real = entities.select("kind", F.col("value").alias("other"), F.lit(True).alias("real"))
    while True:
        first = drawn.groupBy("kind", "other").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("sharing"))
        clashes = materialise(first.join(real, ["kind", "other"], "left").filter("kind <> 'initial' AND (sharing > 1 OR real)"))
        if clashes.isEmpty():
            return drawn
        again = F.col("c.first").isNotNull() & (F.coalesce(F.col("c.real"), F.lit(False)) | (F.col("e.value") != F.col("c.first")))
        next_ = drawn.alias("e").join(clashes.alias("c"), ["kind", "other"], "left").select("kind", F.col("e.value").alias("value"), "n", "draw", "other", again.alias("again"))
        drawn = materialise(next_.withColumn("draw", F.col("draw") + F.col("again").cast("int")).withColumn("other", F.when(F.col("again"), drawing).otherwise(F.col("other"))).drop("again"))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_<kind> mentions of each kind. The same key
    gives the same replacements to the same table."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "t": F.xxhash64("text")})
    mentions = materialise(
        rows.select("d", "t", F.explode(mentions_of(F.col("text"))).alias("x"))
        .select("d", "t", "x.i", "x.m", "x.is", F.posexplode("x.parts").alias("j", "e"))
        .select("d", "t", "i", "m", "is", "j", "e.kind", "e.value")
        .filter("kind IS NOT NULL")
    )
    found = replacements(mentions.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")), key)
    often = max(HOT_LEAST, mentions.count() // partitions(docs.sparkSession))
    rendered = (
        join_hot(mentions, found.select("kind", "value", "n", "other"), ["kind", "value"], "n", often)
        .groupBy("d", "t", "i", "m", "is")
        .agg(F.sort_array(F.collect_set(F.struct("j", "other"))).alias("parts"))
        .select("d", "t", "i", "is", render(F.col("is"), F.col("m"), F.col("parts")).alias("to"))
    )
    of_text = rendered.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("i", "is", "to"))).alias("all"))
    joined = rows.join(of_text, ["d", "t"], "left")
    to = lambda i: F.get(F.filter("all", lambda x: x["i"] == i)["to"], F.lit(0))
    put = F.array_join(F.transform(F.split("text", ANY, -1), lambda p, i: F.concat(p, F.coalesce(to(i), F.lit("")))), "")
    words = lambda ms: F.array_join(F.transform(F.split("text", RUNS, -1), lambda p, i: F.concat(p, F.coalesce(to(i), F.get(ms, i), F.lit("")))), "")
    put = F.when(F.exists("all", lambda x: x["is"] == "name"), let(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0)), words)).otherwise(put)
    n = lambda k: F.coalesce(F.size(F.filter("all", lambda x: x["is"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return joined.select("doc_id", *[n(k) for k in KINDS], F.when(F.col("all").isNull(), F.col("text")).otherwise(put).alias("text"))


def query(spark, sf_dir):
    return surrogates(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY))
