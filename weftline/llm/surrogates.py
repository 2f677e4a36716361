"""PII surrogates: entities are replaced by keyed stand-ins of the same kind and format.

Entities are found by form and context. One regular expression knows the kinds that have a form, and
names after a title or after a common given name. Each text then adds its own: the parts of the
names found in it stand for the same people wherever they recur in it. And given names that titles
show in several texts are looked for, with the word after them, in all texts.

A stand-in depends on a secret key, the kind and the entity's normal form, so an entity has the same
one in the whole corpus (coreference). Given names and surnames are entities of their own, so that
"John Smith", "Mr. Smith" and "Smith" agree. A table of the distinct entities checks for collisions:
two entities with one stand-in, or a stand-in that is itself an entity of the corpus. Of those that
collide the first by normal form stays and the others draw again until all are distinct; later draws
are longer, so that no number of entities uses them up.

Names keep gender and script, cards their leading digit, length and checksum, phones their country code
and punctuation, secrets their alphabet. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_split, let, materialise, release, text_key, workspace

KEY = "weftline-surrogates"
MAX_DRAWS = 60
#: Draws from one length to the next; and the first draw that leaves a fixed format, for when that is nearly full.
GROWS, LEAVES_FORMAT = 2, 12
#: Texts in which a title has to show a given name before it is looked for in all.
SHOWN = 2
#: Characters of a value that are drawn one by one; the rest is hexadecimal digits of the same number.
DRAWN = 256

# Fixed word lists: titles by gender, and given names and surname syllables by script.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Doña Госпожа Κυρία",
    "n": "Dr Prof Doctor Professor",
}
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Arthur Bruno Carl Daniel David Edgar Emil Felix Frank Georg Hugo Ivan Jakob Jonas Julian Karl Leon Louis Luca Marco Martin Max Nico Noah Oscar Otto Paul Peter Ralph Robert Simon Stefan Thomas Tim Victor Walter William".split(),
    ("latin", "f"): "Ada Alice Amelia Anna Carla Clara Diana Elena Ella Emma Eva Flora Greta Hanna Helena Ida Irene Julia Karin Laura Lea Lena Lina Lucia Maria Marta Mia Nina Nora Olga Paula Rita Rosa Sara Silvia Sofia Stella Teresa Vera Zoe".split(),
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Владимир Дмитрий Иван Игорь Константин Максим Михаил Николай Олег Павел Сергей".split(),
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Ирина Лидия Любовь Мария Надежда Наталья Ольга Светлана Софья Татьяна".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Στέφανος".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα Δήμητρα".split(),
}
SYLLABLES = {
    "latin": "bar bel ber bran cor dal del den dor fal fen gar gel hal har kel kor lan lin lor mar mel mer mon nor pel ral ran ros sal sen sor tal tan tor val var ven vor wen wil zan".split(),
    "cyrillic": "бар вал вер гал дан дор жар зор кал кор лан лид мар мел нор пал рав рос сан тал тор фен хор чер".split(),
    "greek": "βαρ βελ γαλ γορ δαρ δελ ζαν θαλ καλ κορ λαν λιν μαρ μελ νορ παρ ραν σαν σορ ταλ τορ φαν χαρ χορ".split(),
}
ENDINGS = {"latin": "son ton berg mann ford well ley ard".split(), "cyrillic": "ов ин ев енко".split(), "greek": "ίδης άκης όπουλος".split()}
#: Endings of Cyrillic surnames that take an а for women.
_GENDERED = ("ов", "ин", "ев")

# No group of these repeats without bound unless possessively: Java's matcher would recurse for each turn.
_WORD = r"(?=\p{Lu}['’-]?\p{L})\p{Lu}\p{L}*+(?:['’-]\p{L}{2,}+){0,3}"
_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts.split()), key=len, reverse=True))
_GIVEN = "|".join(sorted({n for ns in GIVEN.values() for n in ns}, key=len, reverse=True))
_BEFORE = rf"(?:{_GIVEN}|\p{{Lu}}\.)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The kinds in the order in which they are tried, as Java regular expressions.
KINDS: dict[str, str] = {
    "secret": r"(?<![\p{L}\d])(?i:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?[^\s\"',;]{6,}",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-](?:[A-Za-z0-9.-]*[A-Za-z0-9-])?\.[A-Za-z]{2,}+",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?<!\d)\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLES})\.? (?:(?:{_BEFORE} ){{1,3}}{_WORD}|{_WORD}(?: {_BEFORE}){{0,2}}(?: {_WORD})?)|(?:{_GIVEN})(?: {_BEFORE}){{0,2}} {_WORD})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A capitalised word before another one.
FIRST = rf"(?<![\p{{L}}'’-])({_WORD})(?= \p{{Lu}}['’-]?\p{{L}})"
_SECRET_HINT = r"(?i:(?:pass|pwd|token|secret|key)[a-z]*[ ]?[=:])"
_NAME_HINT = rf"(?=\p{{Lu}})(?:(?<![\p{{L}}\d])(?:{_TITLES}|{_GIVEN})|(?<![A-Za-z0-9])(?:AKIA|ASIA))"


def hint(text: Column) -> Column:
    """True for every text with an entity, and cheaper than finding them: others are passed through."""
    secret = (text.contains("=") | text.contains(":")) & text.rlike(_SECRET_HINT)
    return F.coalesce(text.contains("@") | text.rlike("[0-9]") | secret | text.rlike(_NAME_HINT), F.lit(False))


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([x for x in KINDS.items() if x[0] != "name"]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


_HEAD = r"^(?i:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?"
_TITLE_HEAD = rf"^(?:{_TITLES})\.? "


def head_of(kind: Column, entity: Column) -> Column:
    """What stays of an entity: the label of a secret, the title of a name."""
    return F.when(kind == "secret", F.regexp_extract(entity, _HEAD, 0)).when(kind == "name", title_of(entity)).otherwise("")


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, _TITLE_HEAD, 0)


def normal_form(kind: Column, value: Column) -> Column:
    """Equal for the spellings of one entity: case of an email or a name, punctuation of numbers."""
    return F.when(kind.isin("email", "given", "surname"), F.lower(value)).when(kind.isin("phone", "card"), F.regexp_replace(value, "[^0-9+]", "")).otherwise(value)


def _drawn(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, draw.cast("string")).cast("binary"), 512)


def _number(hexes: Column, place, width: int = 6) -> Column:
    at = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.substring(hexes, F.pmod(at * 5, F.lit(120)) + 1, F.lit(width)), 16, 10).cast("long")


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _letters(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(number, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CYRILLIC, _GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_ALPHABETS = [("[0-9]", _DIGITS), ("[a-z]", _LOWER), ("[A-Z]", _UPPER), ("[а-яё]", _CYRILLIC), ("[А-ЯЁ]", _CYRILLIC.upper()), (r"[\p{IsGreek}&&\p{Ll}]", _GREEK), (r"[\p{IsGreek}&&\p{Lu}]", _GREEK.upper()), (r"\p{L}", _LOWER)]


def _shaped(value: Column, hexes: Column, only_hex: Column | None = None) -> Column:
    """Each letter a letter of its case and alphabet, each digit a digit; hexadecimal values stay so.

    From DRAWN characters on it is hexadecimal digits, as many as there were characters.
    """
    only_hex = F.lit(False) if only_hex is None else only_hex

    def each(c, i):
        n = _number(hexes, i) + i * 7
        out = F.when(only_hex & c.rlike("[0-9a-f]"), _letters("0123456789abcdef", n))
        for form, alphabet in _ALPHABETS:
            out = out.when(c.rlike(form), _letters(alphabet, n))
        return out.otherwise(c)

    drawn = F.array_join(F.transform(F.filter(F.split(F.substring(value, 1, DRAWN), ""), lambda c: c != ""), each), "")
    more = F.greatest(F.char_length(value) - DRAWN, F.lit(0))
    return F.when(more == 0, drawn).otherwise(F.concat(drawn, F.substring(F.repeat(hexes, (more / 128).cast("int") + 1), F.lit(1), more)))


def _checksummed(digits: Column) -> Column:
    """The digits with the last one set so that the Luhn sum is right."""
    body = F.substring(digits, F.lit(1), F.char_length(digits) - 1)

    def weighed(c, i):
        d = c.cast("int") * F.when(F.pmod(F.char_length(body) - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _more(pick, hexes: Column, n: Column) -> Column:
    """n picks in a row, from places of ``hexes`` that others don't begin with; none for n of 0."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: pick(_number(hexes, i + 10))), "")).otherwise("")


def _name(kind: Column, norm: Column, hexes: Column, gender: Column, draw: Column) -> Column:
    grown = (draw / GROWS).cast("int")

    def of(script: str) -> Column:
        def listed(g):
            return _pick(GIVEN[(script, g)], _number(hexes, 0))

        def syllable(number):
            return _pick(SYLLABLES[script], number)

        more = _more(syllable, hexes, grown)
        own = F.when(gender == "m", listed("m")).when(gender == "f", listed("f")).otherwise(F.when(F.pmod(_number(hexes, 9), F.lit(2)) == 0, listed("m")).otherwise(listed("f")))
        surname = F.concat(syllable(_number(hexes, 1)), syllable(_number(hexes, 2)), more, _pick(ENDINGS[script], _number(hexes, 3)))
        if script == "cyrillic":
            surname = F.when(norm.rlike("[ая]$") & surname.rlike(f"(?:{'|'.join(_GENDERED)})$"), F.concat(surname, F.lit("а"))).otherwise(surname)
        return F.initcap(F.when(kind == "given", F.concat(own, more)).otherwise(surname))

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def stand_in(key: str, kind: Column, norm: Column, gender: Column, draw: Column) -> Column:
    """The stand-in for a normal form; phones and cards in digits alone.

    Names grow by syllables, emails and secrets by letters with the draws. The other kinds keep their
    format for LEAVES_FORMAT draws; after that they grow by digits (IPs by a fifth number).
    """

    def made(h):
        grown = (draw / GROWS).cast("int")
        letters = _more(lambda x: _letters(_LOWER, x), h, grown)
        figures = _more(lambda x: _letters(_DIGITS, x), h, grown - LEAVES_FORMAT // GROWS + 1)
        domain = F.substring_index(norm, "@", -1)
        host = F.when(F.size(F.split(domain, r"\.")) > 2, F.substring_index(domain, ".", 1)).otherwise(F.lit("mail"))
        email = F.concat(_shaped(F.substring_index(norm, "@", 1), h), letters, F.lit("@"), let(_drawn(key, F.lit("domain"), domain, F.lit(0)), lambda d: _shaped(host, d)), F.lit(".example.org"))
        octets = [F.pmod(_number(h, i), F.lit(254)) + 1 for i in range(3)]
        country = F.regexp_extract(norm, r"^\+(?:1|7|[2-9]\d)", 0)
        digits = _shaped(norm, h)
        phone = F.concat(country, F.substring(digits, F.char_length(country) + 1, F.char_length(norm)))
        card = _checksummed(F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(2), F.char_length(norm))))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", F.concat_ws(".", F.lit("10"), *[o.cast("string") for o in octets], F.nullif(figures, F.lit(""))))
            .when(kind == "phone", F.concat(phone, figures))
            .when(kind == "card", F.concat(card, figures))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, F.lit(2), F.char_length(norm)), figures))
            .when(kind == "access", F.concat(F.substring(norm, 1, 4), F.substring(digits, F.lit(5), F.char_length(norm)), figures))
            .when(kind == "secret", F.concat(_shaped(norm, h, norm.rlike("^[0-9a-f]+$")), letters))
            .otherwise(_name(kind, norm, h, gender, draw))
        )

    return let(_drawn(key, kind, norm, draw), made)


def gender_of(title: Column, given: Column) -> Column:
    """By title, else by given name, else 'n'."""
    title = F.regexp_replace(F.btrim(title), r"\.$", "")
    out = F.lit("n")
    for g in "fm":
        names = [n for (_, own), ns in GIVEN.items() if own == g for n in ns]
        out = F.when(given.isin(names), g).otherwise(out)
    for g in "fm":
        out = F.when(title.isin(TITLES[g].split()), g).otherwise(out)
    return out


def _strings() -> Column:
    return F.array().cast("array<string>")


def _body(entity: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.substring(entity, F.char_length(title_of(entity)) + 1, F.char_length(entity)), " ", -1)


def known_parts(names: Column) -> Column:
    """A struct of the surnames and the given names that the names of a text show.

    The last of several words is a surname, the others are given names. A lone word after a title is a
    surname unless the text, or the list of common ones, has it as a given name.
    """
    listed = [n for ns in GIVEN.values() for n in ns]

    def several(bodies):
        last = F.transform(F.filter(bodies, lambda ws: F.size(ws) > 1), lambda ws: F.element_at(ws, -1))
        before = F.flatten(F.transform(F.filter(bodies, lambda ws: F.size(ws) > 1), lambda ws: F.slice(ws, F.lit(1), F.size(ws) - 1)))
        lone = F.transform(F.filter(bodies, lambda ws: F.size(ws) == 1), lambda ws: F.element_at(ws, 1))
        before = F.filter(before, lambda w: ~w.endswith("."))
        return let(
            F.struct(last.alias("l"), before.alias("b"), lone.alias("o")),
            lambda x: F.struct(
                F.array_distinct(F.concat(x["l"], F.filter(x["o"], lambda w: ~w.isin(listed) & ~F.array_contains(x["b"], w)))).alias("surnames"),
                F.array_distinct(F.concat(x["b"], F.filter(x["o"], lambda w: w.isin(listed) & ~F.array_contains(x["l"], w)))).alias("givens"),
            ),
        )

    return let(F.transform(names, _body), several)


def _recurring(parts: Column) -> Column:
    """A pattern for runs of a text's own name parts; null without any. Parts are letters, hyphens and apostrophes."""
    words = F.filter(F.array_union(parts["surnames"], parts["givens"]), lambda w: F.char_length(w) >= 3)
    ordered = F.transform(F.sort_array(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])

    def run(any_of):
        return F.concat(F.lit(r"(?<![\p{L}'’-])(?:"), any_of, F.lit(")(?: (?:"), any_of, F.lit(r")){0,3}(?!\p{L})"))

    return F.when(F.size(words) > 0, let(F.array_join(ordered, "|"), run))


def _whole(extra: Column) -> Column:
    return F.when(extra.isNull(), F.lit(PATTERN)).otherwise(F.concat(F.lit(PATTERN + "|"), extra))


def found_in(texts: DataFrame, learned: Column | None = None) -> DataFrame:
    """doc_id, tk, extra, surnames, givens, es of each text with an entity.

    es are the entities in order; extra is the pattern that was searched for besides PATTERN, or null.
    ``learned`` is a pattern of names to look for as well.
    """
    learned = F.lit(None).cast("string") if learned is None else learned
    is_name = rf"^(?:\p{{Lu}}[^@=:0-9]*)$"

    def first(es):
        names = F.filter(es, lambda e: e.rlike(is_name) & (kind_of(e) == "name"))
        return F.when(F.size(names) > 0, let(known_parts(names), lambda p: F.struct(p["surnames"].alias("surnames"), p["givens"].alias("givens"), F.concat_ws("|", "learned", _recurring(p)).alias("extra"))))

    rows = texts.select("doc_id", "tk", "text", learned.alias("learned")).withColumn("es", F.regexp_extract_all("text", _whole(F.col("learned")), F.lit(0))).filter(F.size("es") > 0)
    rows = rows.withColumn("p", let(F.col("es"), first)).withColumn("extra", F.nullif("p.extra", F.lit("")))
    es = F.when(F.col("extra").isNull(), F.col("es")).otherwise(F.regexp_extract_all("text", _whole(F.col("extra")), F.lit(0)))
    return rows.select("doc_id", "tk", "extra", F.coalesce("p.surnames", _strings()).alias("surnames"), F.coalesce("p.givens", _strings()).alias("givens"), es.alias("es"))


def shown_names(found: DataFrame, path: str) -> DataFrame:
    """w: given names that follow a title in SHOWN texts or more, but for the common ones."""
    names = found.select("doc_id", "tk", F.explode("es").alias("e")).filter(title_of(F.col("e")) != "").select("doc_id", "tk", _body(F.col("e")).alias("ws"))
    first = names.filter(F.size("ws") > 1).select(F.col("ws")[0].alias("w"), "doc_id", "tk").filter(~F.col("w").endswith(".") & ~F.col("w").isin([n for ns in GIVEN.values() for n in ns]))
    shown = first.distinct().groupBy("w").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SHOWN)
    return materialise(shown.select("w"), f"{path}/shown")


def texts_with(docs: DataFrame, shown: DataFrame, path: str) -> DataFrame:
    """doc_id, tk, learned: a pattern of those of the ``shown`` given names that a text has before a capitalised word."""
    firsts = docs.select("doc_id", "tk", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FIRST), F.lit(1)))).alias("w"))
    firsts = materialise(firsts, f"{path}/firsts")
    counts = materialise(firsts.groupBy("w").agg(F.count(F.lit(1)).alias("times")).join(shown, "w"), f"{path}/first-counts")
    mine = join_split(firsts, counts, ["w"], "times", firsts.count()).groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    pattern = F.concat(F.lit(r"(?<![\p{L}'’-])(?:"), F.array_join("ws", "|"), F.lit(f") {_WORD}"))
    return materialise(mine.select(F.col("doc_id").alias("d"), F.col("tk").alias("k"), pattern.alias("learned")), f"{path}/texts-with")


def entities(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tk, extra, hinted, surnames, givens, es of each text with an entity; see found_in()."""
    docs = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")
    found = materialise(found_in(docs.filter(hint(F.col("text")))).withColumn("hinted", F.lit(True)), f"{path}/found")
    shown = shown_names(found, path)
    if not shown.limit(1).count():
        return found
    having = texts_with(docs, shown, path)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k"))
    again = docs.join(having, same).select("doc_id", "tk", "text", "learned", hint(F.col("text")).alias("hinted"))
    hints = found_in(again.filter("hinted"), F.col("learned")).withColumn("hinted", F.lit(True))
    others = found_in(again.filter(~F.col("hinted")), F.col("learned")).withColumn("hinted", F.lit(False))
    return materialise(found.join(having, same, "left_anti").unionByName(hints).unionByName(others), f"{path}/found-again")


def entity_parts(found: DataFrame) -> DataFrame:
    """doc_id, tk, extra, hinted, place, entity, part, kind, head, value, norm, gender.

    Place counts the entities of a text and part the words of a name; head is what stays before a
    value. Entities that are no names have one part.
    """
    rows = found.select("doc_id", "tk", "extra", "hinted", "surnames", "givens", F.posexplode("es").alias("place", "entity")).withColumn("form", kind_of(F.col("entity")))
    rows = rows.withColumn("top", head_of(F.col("form"), F.col("entity")))
    words = F.split(F.substring(F.col("entity"), F.char_length("top") + 1, F.char_length("entity")), " ", -1)
    listed = [n for ns in GIVEN.values() for n in ns]

    def of_name(ws):
        def each(w, i):
            lone = F.when(F.array_contains("surnames", w), "surname").when(F.array_contains("givens", w) | w.isin(listed), "given").otherwise("surname")
            kind = F.when(w.endswith("."), "initial").when(i < F.size(ws) - 1, "given").when(F.size(ws) > 1, "surname").otherwise(lone)
            return F.struct(i.alias("part"), kind.alias("kind"), F.when(i == 0, F.col("top")).otherwise(" ").alias("head"), w.alias("value"))

        return F.transform(ws, each)

    single = F.array(F.struct(F.lit(0).alias("part"), F.col("form").alias("kind"), F.col("top").alias("head"), F.substring(F.col("entity"), F.char_length("top") + 1, F.char_length("entity")).alias("value")))
    parts = F.when(F.col("form") == "name", let(words, of_name)).otherwise(single)
    rows = rows.select("doc_id", "tk", "extra", "hinted", "place", "entity", "top", F.inline(parts))
    gender = F.when(F.col("kind") == "given", gender_of(F.col("top"), F.col("value"))).otherwise("n")
    return rows.withColumn("norm", normal_form(F.col("kind"), F.col("value"))).withColumn("gender", gender).drop("top")


def dictionary(parts: DataFrame, key: str, path: str) -> DataFrame:
    """kind, norm, times, stand: one distinct stand-in for each distinct entity.

    A stand-in may be no entity's normal form either, but for given names, which are few and shared.
    Each turn draws for those still without one alone.
    """
    known = parts.groupBy("kind", "norm").agg(F.min("gender").alias("gender"), F.count(F.lit(1)).alias("times"))
    known = materialise(known, f"{path}/distinct")
    same = ["kind", "plain"]
    taken = known.filter(F.col("kind") != "given").select("kind", F.col("norm").alias("plain"))
    settled = None
    for turn in range(MAX_DRAWS):
        drawn = known.withColumn("stand", stand_in(key, F.col("kind"), F.col("norm"), F.col("gender"), F.lit(turn)))
        drawn = drawn.withColumn("plain", F.when(F.col("kind").isin("given", "surname"), F.lower("stand")).otherwise(F.col("stand")))
        drawn = materialise(drawn, f"{path}/drawn-{turn}")
        first = drawn.groupBy(*same).agg(F.min_by(F.struct("norm", "gender", "times", "stand"), "norm").alias("x")).select(*same, "x.*")
        # by merge: what is taken is a table that grows with the corpus
        won = materialise(first.join(taken.hint("merge"), same, "left_anti"), f"{path}/won-{turn}")
        known = materialise(drawn.join(won.select("kind", "norm").hint("merge"), ["kind", "norm"], "left_anti").drop("stand", "plain"), f"{path}/left-{turn}")
        settled = won if settled is None else settled.unionByName(won)
        if not known.limit(1).count():
            return settled.select("kind", "norm", "times", "stand")
        taken = taken.unionByName(won.select(*same))
    raise ValueError(f"stand-ins still collide after {MAX_DRAWS} draws")


def _refilled(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced, in order, by those of ``digits``, and what is left of them after it."""

    def step(acc, c):
        isdigit = c.rlike("[0-9]")
        return F.struct(
            F.concat(acc["out"], F.when(isdigit, F.substring(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (acc["n"] + F.when(isdigit, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(F.filter(F.split(entity, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda acc: F.concat(acc["out"], F.substring(digits, acc["n"] + 1, F.char_length(digits))))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, kinds, text of each row, the entities of the text replaced.

    kinds lists the kinds found, in order of place; a name is one entity, however many words it has.
    Null texts stay null and empty ones empty. Rows that share a doc_id are treated one by one, as are
    rows with a null doc_id; equal texts get equal results. Where stand-ins tie, the entity whose
    normal form comes first keeps its own. A text is searched whole, however long; of a value of over
    DRAWN characters the rest becomes hexadecimal digits. An empty table gives no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    path = workspace(spark, "pii")
    docs = docs.select("doc_id", "text")
    parts = materialise(entity_parts(entities(docs, path)), f"{path}/parts")
    named = parts.filter(F.col("kind") != "initial")
    stands = dictionary(named, key, path)
    release(spark)
    stand = F.when(F.col("kind").isin("given", "surname") & (F.col("value") == F.upper("value")), F.upper("stand")).otherwise(F.col("stand"))
    new = F.when(F.col("kind").isin("phone", "card"), _refilled(F.col("entity"), F.regexp_replace("stand", "[^0-9]", ""))).otherwise(F.concat("head", stand))
    # by merge, but for keys of many rows: the dictionary grows with the corpus
    replaced = join_split(named, stands.hint("merge"), ["kind", "norm"], "times", named.count()).withColumn("new", new)
    kept = parts.filter(F.col("kind") == "initial").withColumn("new", F.concat("head", "value"))
    cols = ["doc_id", "tk", "extra", "hinted", "place", "part", "new", F.when(F.col("kind").isin("given", "surname", "initial"), "name").otherwise(F.col("kind")).alias("kind")]
    per_text = replaced.select(*cols).unionByName(kept.select(*cols)).groupBy(F.col("doc_id").alias("d"), F.col("tk").alias("k"), "hinted").agg(F.max("extra").alias("extra"), F.sort_array(F.collect_set(F.struct("place", "part", "new", "kind"))).alias("es"))
    per_text = materialise(per_text, f"{path}/per-text")
    hinted = hint(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k"))
    rows = docs.withColumn("tk", text_key(F.col("text")))

    def rebuilt(pieces):
        texts = F.transform("es", lambda e: F.concat(F.when(e["part"] == 0, F.coalesce(F.get(pieces, e["place"]), F.lit(""))).otherwise(""), e["new"]))
        return F.concat(F.array_join(texts, ""), F.element_at(pieces, -1))

    def with_entities(rows: DataFrame) -> DataFrame:
        firsts = F.filter("es", lambda e: e["part"] == 0)
        return rows.select(
            "doc_id", F.coalesce(F.size(firsts), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.transform(firsts, lambda e: e["kind"]), _strings()).alias("kinds"),
            F.when(F.col("es").isNull(), F.col("text")).otherwise(let(F.split(F.col("text"), _whole(F.col("extra")), -1), rebuilt)).alias("text"),
        )

    out = with_entities(rows.filter(hinted).join(per_text.filter("hinted"), same, "left"))
    others = rows.filter(~hinted)
    if per_text.filter(~F.col("hinted")).limit(1).count():
        return out.unionByName(with_entities(others.join(per_text.filter(~F.col("hinted")), same, "left")))
    return out.unionByName(others.select("doc_id", F.lit(0).cast("long").alias("n_entities"), _strings().alias("kinds"), "text"))


def python_pattern(pattern: str = PATTERN):
    """The same expression for Python's regex module, for tests."""
    import regex

    return regex.compile(pattern)
