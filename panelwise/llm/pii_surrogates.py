"""Personal data replaced by keyed surrogates (native).

Each entity found in the corpus (an e-mail address, a phone, card, account or
national number, an IP address, a secret, a name after a form of address)
gets one surrogate of its kind: derived from a secret key by SHA-512, of the
same length, character classes, script and, for names, gender.  All mentions
of an entity get its surrogate in their own format, so coreference holds;
within a text, also bare mentions of a name's words that have a form of
address elsewhere in it.
Surrogates are checked against each other and against all real entities; a
collision is derived again until none is left, so different entities stay
different and no surrogate is someone else's datum.

A text is searched once.  Cheap tests tell which groups of patterns it can
match at all, and only those are tried; what is found is marked in a written
copy of the text, and replaced there by its place.  Texts without entities are
not shuffled; entities are gathered once per different text.  Digits in the
groups of a card are one only if their check digit holds.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.shared import joined_small, written

MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Mister", "Sir", "Lord")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Lady", "Dame", "Señorita", "Srta", "Mademoiselle", "Mlle")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Rev", "Доктор", "Профессор")
_SECRET = r"(?:password|passwd|pwd|secret|token|api[_-]?key)"
_TITLES = rf"(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? )+"
#: A word of a name, and what may stand before one and is kept: particles and initials.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
_BETWEEN = r"(?:(?:von|van|der|den|de|del|della|di|da|du|la|le|zu) |\p{Lu}\. ?)*"
_H = "[0-9A-Fa-f]{1,4}"
#: Phone numbers that begin with neither + nor a bracket: 00 and a country, 0 and an area, three groups of 3, 3 and 4, pairs after 0.
_DOMESTIC = (r"(?<![\w.+-])(?:00[1-9]\d{0,2}(?:[ ./-](?:\(0\))?\d{2,8}){2,4}|00[1-9]\d{9,12}|0[1-9]\d{1,4}[ /-](?:\d{3,4}[ -]\d{3,5}|\d{5,8})"
             r"|0[1-9](?: \d{2}){4}|0[1-9](?:\.\d{2}){4}|(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}))(?!\w|[.-]\d)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: What is looked for, in this order where several match at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"(?<![A-Za-z])(?i:{_SECRET})\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_-]{{8,}}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|" + _DOMESTIC,
    "ip6": rf"(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]{{0,35}}[0-9A-Fa-f]{{3}})(?:{_H}(?::{_H}){{0,6}})?::(?:(?:{_H}:){{0,5}}(?:{_OCTET}\.){{3}}{_OCTET}|(?:{_H}(?::{_H}){{0,6}})?))(?![\w:]|\.\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)|(?<![\d-])\d{4}(?: \d{6} |-\d{6}-)\d{4,5}(?!\d)",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}}){_TITLES}{_BETWEEN}{_WORD}(?:[ -]{_BETWEEN}{_WORD}){{0,3}}",
}
#: Patterns by what a text must hold to match one of them; a text is searched for the groups that it can match.
GROUPS = {"signs": ("email", "secret", "access_key"), "digits": ("phone", "ip6", "ip", "national", "card", "account"), "names": ("name",)}
_FIRST = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
NEEDED = {
    "signs": [r"@", r"AKIA", rf"(?i:{_SECRET})\s{{0,3}}[=:]"],
    "digits": [r"[0-9][0-9 ()./+-]{5}", r"[A-Z]{2}[0-9]{2}", r":[0-9A-Fa-f]{0,4}:"],
    "names": [rf"(?=[{_FIRST}]){_TITLES}"],
}
#: Around a mention in a marked text, and for the first of its characters where the text itself has it.
MARK, OWN = "\uFDD0\uFDD1", "\uFDD0\uFDD2"
#: Syllables that surrogate names are built of, by script.
SYLLABLES = {"latin": "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za".split(),
             "cyrillic": "ба ве ги до жу за ке ли мо ну па ре си то фу ха це чи шо ща".split()}
#: Derivations in the usual form; later ones are longer, so that no kind runs out of surrogates.
ROUNDS, MORE_ROUNDS = 24, 40


def _kind(m: Column) -> Column:
    starts = lambda p: m.rlike(p)
    return (F.when(m.contains("@"), "email").when(starts(rf"^(?i:{_SECRET})\s*[=:]"), "secret").when(starts("^AKIA[A-Z0-9]{16}$"), "access_key")
            .when(starts(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"), "ip6").when(starts(r"^[+(]") | starts(f"^(?:{_DOMESTIC})$"), "phone").when(starts(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(starts(r"^\d{3}-\d{2}-\d{4}$"), "national")
            .when(starts(r"^\d"), "card").when(starts(r"^[A-Z]{2}\d{2}"), "account").otherwise("name"))


def _units(mentions: DataFrame) -> DataFrame:
    """``mention, kind, place, unit, core``: what of a mention is replaced; a name has a unit for each of its words."""
    d = mentions.withColumn("kind", _kind(F.col("mention")))
    m, k = F.col("mention"), F.col("kind")
    core = (F.when(k == "email", F.lower(m)).when(k == "secret", F.regexp_extract(m, rf"^(?i:{_SECRET})\s*[=:]\s*[\"']?(.*)$", 1))
            .when(k == "ip6", F.lower(m)).when(k.isin("ip", "access_key"), m).otherwise(F.regexp_replace(m, "[^A-Za-z0-9]", "")))
    titles = F.regexp_extract(m, f"^({_TITLES})", 1)
    called = lambda words: titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})")
    parts = F.regexp_extract_all(F.regexp_replace(m, f"^{_TITLES}", ""), F.lit(_WORD), 0)
    given = F.when(called(FEMALE), "given female").when(called(MALE), "given male").otherwise("given")
    names = F.transform(parts, lambda x, i: F.struct(i.alias("place"), F.when(F.size(parts) - 1 == i, "family").otherwise(given).alias("unit"), x.alias("core")))
    single = F.array(F.struct(F.lit(0).alias("place"), k.alias("unit"), core.alias("core")))
    d = d.select("mention", "kind", F.explode(F.when(k == "name", names).otherwise(single)).alias("u")).select("mention", "kind", "u.*")
    # a given name after a title of no gender is one that has a gender elsewhere, if it has
    known = d.where(F.col("unit").isin("given female", "given male")).groupBy("core").agg(F.min("unit").alias("known"))
    open_ = d.where("unit = 'given'").join(known, "core", "left").withColumn("unit", F.coalesce("known", "unit"))
    return d.where("unit <> 'given'").unionByName(open_.select(d.columns))


def _digits(core: Column) -> Column:
    return F.transform(F.split(core, ""), lambda c: c.cast("int"))


def _luhn(core: Column) -> Column:
    """The weighted sum of a card's digits, 0 modulo 10 for a valid one."""
    doubled = F.transform(F.reverse(_digits(core)), lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _mod97(account: Column) -> Column:
    """An account number's remainder, its first four characters last: 1 for a valid one."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _derived(unit: Column, core: Column, key: str, attempt: int) -> Column:
    """The surrogate of a unit at an attempt: bytes of a keyed digest mapped to the character classes of ``core``.

    Cards, and accounts whose check digits hold, get check digits that hold.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), unit, core), 512)
    byte = lambda i: F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    hexadecimal = core.rlike("^[0-9a-f]+$") & core.rlike("[0-9]")
    kept = F.when(unit == "phone", F.greatest(F.length(core) - 10, F.length(F.regexp_extract(core, "^(0{1,2}[1-9]|)", 1)))).when(unit == "access_key", 4).when(unit == "card", 1).when(unit == "account", 2).otherwise(0)
    letter = lambda i, first, n=26: F.char(F.lit(first) + byte(i) % n)

    def mapped(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i < kept, c)
                                        .when((unit == "secret") & hexadecimal, F.lower(F.hex(byte(i) % 16)))
                                        .when(c.rlike("[0-9]"), (byte(i) % 10).cast("string"))
                                        .when(c.rlike("[a-z]"), letter(i, 97)).when(c.rlike("[A-Z]"), letter(i, 65)).otherwise(c)), "")

    more = F.lit("" if attempt < 8 else str(attempt))  # short ones run out of others of their length
    local = F.concat(mapped(F.regexp_extract(core, "^([^@]*)", 1)), more, F.lit("@example.org"))
    ip = F.concat_ws(".", (F.lit(240) + byte(F.lit(0)) % 15).cast("string"), *[byte(F.lit(i)).cast("string") for i in (1, 2, 3)])
    ip6 = F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.lpad(F.hex(byte(F.lit(2 * i)) * 256 + byte(F.lit(2 * i + 1))), 4, "0")) for i in range(6)])
    syllable = lambda script, i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), byte(F.lit(i)) % 20 + 1)
    name = lambda script, ends: F.initcap(F.concat(*[syllable(script, i) for i in range(3 + attempt // 8)], ends))
    cyrillic = core.rlike(r"\p{IsCyrillic}")
    named = F.when(cyrillic, name("cyrillic", F.when(unit == "given female", "на").when(unit.startswith("given"), "н").otherwise("к"))).otherwise(
        name("latin", F.when(unit == "given female", "na").when(unit.startswith("given"), "n").otherwise("ck")))
    # a kind that is full takes longer ones: a digit more each time, and IPv6 for IPv4
    longer = F.concat(*[(byte(F.lit(63 - i)) % 10).cast("string") for i in range(attempt - ROUNDS + 1)]) if attempt >= ROUNDS else F.lit("")
    digits = mapped(core)
    head = F.substr(digits, F.lit(1), F.length(core) - 1)
    card = F.concat(head, longer, ((10 - _luhn(F.concat(head, longer, F.lit("0")))) % 10).cast("string"))
    bank = F.concat(F.substr(digits, F.lit(1), F.lit(2)), F.lit("00"), F.substr(digits, F.lit(5)), longer)
    checked = F.concat(F.substr(bank, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(bank)).cast("string"), 2, "0"), F.substr(bank, F.lit(5)))
    account = F.when(_mod97(core) == 1, checked).otherwise(F.concat(digits, longer))
    return (F.when(unit == "email", local).when(unit == "ip", ip6 if attempt >= ROUNDS else ip).when(unit == "ip6", ip6).when(unit == "card", card).when(unit == "account", account)
            .when(unit.isin("family", "given", "given female", "given male"), named).otherwise(F.concat(digits, longer)))


def surrogates(units: DataFrame, key: str) -> DataFrame:
    """``unit, core, surrogate`` for all different entities, one-to-one within a unit and never a real entity of any unit.

    A kind with fewer surrogates of its form than entities gets longer ones.
    """
    left = written(units.select("unit", "core").distinct(), "pii-entities")
    real, accepted = left.select(F.col("core").alias("surrogate")).distinct(), None
    for attempt in range(ROUNDS + MORE_ROUNDS):
        tried = written(left.withColumn("surrogate", _derived(F.col("unit"), F.col("core"), key, attempt)), "pii-tried")
        first = tried.groupBy("unit", "surrogate").agg(F.min("core").alias("core"))
        free = first.join(real, "surrogate", "left_anti")
        if accepted is not None:
            free = free.join(accepted, ["unit", "surrogate"], "left_anti")
        free = written(free.select("unit", "core", "surrogate"), "pii-free")
        accepted = free if accepted is None else accepted.unionByName(free)
        left = written(left.join(free, ["unit", "core"], "left_anti"), "pii-left")
        if left.isEmpty():
            return accepted
    raise ValueError(f"entities without a surrogate of their own: {left.groupBy('unit').count().collect()}")


def _formatted(kind: Column, mention: Column, found: Column) -> Column:
    """A mention with its surrogates: in its own separators, its own case for an address."""
    s = F.element_at(found, 1)["surrogate"]
    before = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^A-Za-z0-9]", ""))
    walked = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(
        c.rlike("[A-Za-z0-9]"), F.substr(s, before(i) + 1, F.lit(1))).otherwise(c)), "")
    walked = F.concat(walked, F.substr(s, before(F.length(mention)) + 1))  # of a longer surrogate
    prefix = F.regexp_extract(mention, rf"^((?i:{_SECRET})\s*[=:]\s*[\"']?)", 1)
    title = F.regexp_extract(mention, f"^({_TITLES})", 1)
    kept = F.split(F.regexp_replace(mention, f"^{_TITLES}", ""), _WORD, -1)
    named = F.concat(title, F.array_join(F.flatten(F.zip_with(kept, found, lambda a, b: F.array(a, F.coalesce(b["surrogate"], F.lit(""))))), ""))
    return (F.when(kind == "email", F.when(mention == F.upper(mention), F.upper(s)).otherwise(s)).when(kind == "secret", F.concat(prefix, s))
            .when(kind.isin("ip", "ip6", "access_key"), s).when(kind == "name", named).otherwise(walked))


def marked(text: Column) -> Column:
    """The text with a mark before and after each mention; null where there is none."""
    groups = {g: "|".join(PATTERNS[k] for k in kinds) for g, kinds in GROUPS.items()}
    can = {g: text.rlike("|".join(needed)) for g, needed in NEEDED.items()}
    own = F.replace(text, F.lit(MARK[0]), F.lit(OWN))
    around = F.lit(f"{MARK}$0{MARK}")
    found = None
    for chosen in sorted(itertools.product([True, False], repeat=len(groups)), reverse=True):
        kept = [g for g, c in zip(groups, chosen) if c]
        if kept:
            here = can[kept[0]]
            for g in kept[1:]:
                here = here & can[g]
            marks = F.regexp_replace(own, F.lit("|".join(groups[g] for g in kept)), around)
            found = F.when(here, marks) if found is None else found.when(here, marks)
    return F.when(found.contains(MARK), found)


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(OWN), F.lit(MARK[0]))


def _joined(parts: Column, new: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(parts, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _rewritten(parts: Column, plain) -> Column:
    """Parts between marks by ``plain``, mentions (every second one) by ``_new``, which has them by their number."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, plain(p)).otherwise(F.coalesce(F.try_element_at("_new", F.floor(i / 2).cast("int")), p))), "")


def _bare_pattern() -> Column:
    cores = F.array_distinct(F.transform("_words", lambda x: x["core"]))
    return F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.reverse(F.array_sort(cores)), "|"), F.lit(r")(?!\p{L})"))  # longer ones first


def _bare_names_replaced(part: Column) -> Column:
    """A part of a text with the bare words of the text's own names (``_words``) replaced; a word that is both is a family name."""
    pattern = _bare_pattern()
    word = lambda m: F.get(F.filter("_words", lambda x: x["core"] == m), F.lit(0))["surrogate"]  # noqa: E731  (in the order of units)
    return _joined(F.split(part, pattern, -1), F.transform(F.regexp_extract_all(part, pattern, F.lit(0)), word))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities replaced in ``text`` and ``_n_entities`` added.

    Null and empty texts have no entity; texts of any length are treated
    whole; equal texts are replaced alike, a row each; an empty table gives no
    rows; all columns are kept (``n_chars``, if there, counts the new text).
    """
    searched = written(docs.withColumn("_marked", marked(F.col("text"))), "pii-marked")
    plain = searched.where("_marked IS NULL").select(*docs.columns, F.lit(0).alias("_n_entities"))
    d = searched.where("_marked IS NOT NULL").withColumn("_digest", F.sha2(F.col("_marked").cast("binary"), 256)).withColumn("_parts", F.split("_marked", F.lit(MARK), -1))
    texts = d.select("_digest", F.filter("_parts", lambda _, i: i % 2 == 1).alias("found"))
    texts = written(texts.groupBy("_digest").agg(F.first("found").alias("found")), "pii-texts")
    each = texts.select("_digest", F.posexplode("found").alias("at", "mention"))
    mentions = each.select("mention").distinct().withColumn("kind", _kind(F.col("mention")))
    mentions = mentions.where((F.col("kind") != "card") | (_luhn(F.regexp_replace("mention", "[^0-9]", "")) == 0)).drop("kind")
    units = written(_units(mentions), "pii-units")
    named = units.join(surrogates(units, key), ["unit", "core"])
    found = F.sort_array(F.collect_list(F.struct("place", "surrogate", "core", "unit")))  # as many as a name has words
    named = named.groupBy("mention", "kind").agg(found.alias("found"))
    words = F.when(F.col("kind") == "name", F.transform("found", lambda x: F.struct(x["core"], x["unit"], x["surrogate"])))
    named = written(named.select("mention", _formatted(F.col("kind"), F.col("mention"), F.col("found")).alias("new"), words.alias("words")), "pii-mentions")
    new = joined_small(each, named, "mention").groupBy("_digest").agg(  # a text's own
        F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("_new"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias("_words"))
    new = written(new, "pii-replacements")
    d = d.join(new, "_digest", "left")
    without = F.when(F.size("_words") > 0, F.lit(False)).otherwise(F.lit(True))
    alone = d.where(without).withColumn("text", _rewritten(F.col("_parts"), lambda p: p)).withColumn("_n_entities", F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new")))
    named_words = F.aggregate(F.filter("_parts", lambda _, i: i % 2 == 0), F.lit(0), lambda a, p: a + F.size(F.regexp_extract_all(p, _bare_pattern(), F.lit(0))))
    bare = d.where(~without).withColumn("_n_entities", F.size("_new") + named_words).withColumn("text", _rewritten(F.col("_parts"), _bare_names_replaced))
    d = alone.unionByName(bare).withColumn("text", _unmarked(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("_n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns, "_n_entities").unionByName(plain)
