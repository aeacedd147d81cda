"""Vocabulary of the two languages, as data.

All words are stored folded (lower case, no accents). New vocabulary is a new
entry here, never a new branch in the grammar.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import fold, trim_space


def words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def phrases(text: str) -> tuple[str, ...]:
    return tuple(p.strip() for p in text.split(",") if p.strip())


def numbered(text: str, first: int = 0, step: int = 1) -> dict[str, float]:
    return {w: float(first + step * k) for k, w in enumerate(text.split())}


def unit_forms(text: str) -> dict[str, str]:
    """``canonical form form; canonical form`` to form -> canonical."""
    forms = {}
    for group in text.split(";"):
        names = group.split()
        for name in names:
            forms[name] = names[0]
    return forms


@dataclass(frozen=True)
class Language:
    code: str
    nouns: tuple[str, ...]
    kept_nouns: tuple[str, ...]
    preps: tuple[str, ...]
    articles: tuple[str, ...]
    ones: dict[str, float]
    tens: dict[str, float]
    hundreds: dict[str, float]
    hundred: tuple[str, ...]
    big: dict[str, float]
    dozen: tuple[str, ...]
    half: tuple[str, ...]
    connectors: tuple[str, ...]
    number_articles: tuple[str, ...]
    approx: tuple[str, ...]
    vague: dict[str, float | None]
    units: dict[str, str]
    of: tuple[str, ...]
    confirm: tuple[str, ...]
    reject: tuple[str, ...]
    scratch: tuple[str, ...]
    negation: tuple[str, ...]
    fields: dict[str, str]
    is_words: tuple[str, ...]
    change: tuple[str, ...]
    to_words: tuple[str, ...]
    conjunctions: tuple[str, ...]
    extra: dict = field(default_factory=dict)

    @cached_property
    def vocabulary(self) -> list[str]:
        """Every word the utterance grammar has to recognise."""
        found = set(self.nouns) | set(self.preps) | set(self.articles)
        found |= set(self.ones) | set(self.tens) | set(self.hundreds) | set(self.big)
        found |= set(self.hundred) | set(self.dozen) | set(self.half) | set(self.connectors)
        found |= set(self.number_articles) | set(self.units) | set(self.of)
        found |= set(self.conjunctions)
        for phrase in (*self.approx, *self.vague, *self.negation):
            found.add(phrase.split()[0])
        return sorted(found)


# ---------------------------------------------------------------------------
# English vocabulary.

ENGLISH = Language(
    code="en",
    nouns=words("bin location shelf rack aisle row bay slot area zone section dock cage pallet"),
    kept_nouns=words("shelf rack aisle row bay slot area zone section dock cage pallet"),
    preps=words("in at on"),
    articles=words("the"),
    ones=numbered(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen "
        "fourteen fifteen sixteen seventeen eighteen nineteen"
    ),
    tens=numbered("twenty thirty forty fifty sixty seventy eighty ninety", 20, 10),
    hundreds={},
    hundred=words("hundred"),
    big={"thousand": 1e3, "million": 1e6},
    dozen=words("dozen dozens"),
    half=words("half"),
    connectors=words("and"),
    number_articles=words("a an"),
    approx=phrases(
        "about, around, approximately, roughly, maybe, like, nearly, almost, close to, "
        "more or less, some"
    ),
    vague={
        "a couple": 2.0, "couple": 2.0, "a few": 3.0, "a handful": 3.0,
        "several": None, "some": None, "many": None, "a bunch": None, "a lot": None, "lots": None,
    },
    units=unit_forms(
        "box boxes; spool spools; reel reels; bag bags; each ea; piece pieces pcs pc; "
        "foot feet ft; meter meters metre metres; inch inches; yard yards; roll rolls; "
        "case cases; carton cartons; unit units; pack packs package packages; can cans; "
        "bottle bottles; coil coils; pair pairs; set sets; sheet sheets; tube tubes; "
        "drum drums; bucket buckets; crate crates; bundle bundles; length lengths; "
        "kilogram kilograms kilo kilos kg; gram grams; pound pounds lb lbs; "
        "liter liters litre litres; gallon gallons"
    ),
    of=words("of"),
    confirm=words(
        "yes yeah yep yup correct confirm confirmed right ok okay affirmative good save"
    ),
    reject=words("no nope wrong incorrect negative"),
    scratch=phrases(
        "scratch that, scratch it, delete, delete that, delete it, cancel, cancel that, "
        "discard, discard that, never mind, nevermind"
    ),
    negation=phrases("no, nope, wait, sorry, actually, correction, i mean, make that, make it"),
    fields={
        "location": "location", "loc": "location", "place": "location",
        "quantity": "quantity", "qty": "quantity", "count": "quantity",
        "number": "quantity", "amount": "quantity",
        "item": "item", "part": "item", "product": "item", "name": "item",
        "unit": "unit", "units": "unit", "uom": "unit",
        "description": "description", "note": "description", "notes": "description",
        "comment": "description", "details": "description",
    },
    is_words=words("is equals"),
    change=words("change set make update"),
    to_words=words("to"),
    conjunctions=words("and plus"),
)

# ---------------------------------------------------------------------------
# Spanish vocabulary.

SPANISH = Language(
    code="es",
    nouns=words(
        "bin contenedor ubicacion estante estanteria anaquel pasillo fila rack bahia ranura "
        "zona seccion area casilla cajon deposito lugar"
    ),
    kept_nouns=words(
        "estante estanteria anaquel pasillo fila rack bahia ranura zona seccion area"
    ),
    preps=words("en"),
    articles=words("el la los las del al"),
    ones={
        **numbered(
            "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce "
            "quince dieciseis diecisiete dieciocho diecinueve"
        ),
        **numbered(
            "veintiuno veintidos veintitres veinticuatro veinticinco veintiseis veintisiete "
            "veintiocho veintinueve", 21,
        ),
        "un": 1.0, "una": 1.0, "veintiun": 21.0, "veintiuna": 21.0,
    },
    tens=numbered(
        "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa", 20, 10
    ),
    hundreds={
        "doscientos": 200.0, "doscientas": 200.0, "trescientos": 300.0, "trescientas": 300.0,
        "cuatrocientos": 400.0, "cuatrocientas": 400.0, "quinientos": 500.0, "quinientas": 500.0,
        "seiscientos": 600.0, "seiscientas": 600.0, "setecientos": 700.0, "setecientas": 700.0,
        "ochocientos": 800.0, "ochocientas": 800.0, "novecientos": 900.0, "novecientas": 900.0,
    },
    hundred=words("cien ciento"),
    big={"mil": 1e3, "millon": 1e6, "millones": 1e6},
    dozen=words("docena docenas"),
    half=words("media medio"),
    connectors=words("y"),
    number_articles=words("un una uno"),
    approx=phrases(
        "unos, unas, aproximadamente, como, casi, mas o menos, cerca de, alrededor de, por ahi"
    ),
    vague={
        "un par": 2.0, "unos pocos": 3.0, "unas pocas": 3.0, "un punado": 3.0,
        "varios": None, "varias": None, "algunos": None, "algunas": None,
        "muchos": None, "muchas": None, "un monton": None,
    },
    units=unit_forms(
        "caja cajas cajitas; carrete carretes; bobina bobinas; bolsa bolsas; pieza piezas; "
        "unidad unidades; rollo rollos; paquete paquetes; lata latas; botella botellas; "
        "juego juegos; lamina laminas; tubo tubos; tambor tambores; cubeta cubetas; "
        "metro metros; pie pies; pulgada pulgadas; kilo kilos kilogramo kilogramos; "
        "gramo gramos; litro litros; galon galones; par pares"
    ),
    of=words("de del"),
    confirm=words(
        "si correcto confirmar confirmado dale vale claro afirmativo ok okay listo bueno guarda"
    ),
    reject=words("no incorrecto mal negativo"),
    scratch=phrases(
        "borra eso, borralo, borrar, cancela, cancelar, cancela eso, elimina eso, eliminalo, "
        "eliminar, descarta, descartalo, olvidalo, tacha eso, anula"
    ),
    negation=phrases("no, digo, perdon, espera, mejor dicho, corrijo, en realidad"),
    fields={
        "ubicacion": "location", "lugar": "location", "sitio": "location", "bin": "location",
        "cantidad": "quantity", "numero": "quantity", "cuenta": "quantity",
        "articulo": "item", "pieza": "item", "parte": "item", "producto": "item",
        "item": "item", "nombre": "item",
        "unidad": "unit", "unidades": "unit",
        "descripcion": "description", "nota": "description", "notas": "description",
        "comentario": "description", "detalle": "description", "detalles": "description",
    },
    is_words=words("es"),
    change=words("cambia cambiar pon poner actualiza"),
    to_words=words("a por"),
    conjunctions=words("y e"),
)

LANGUAGES = {"en": ENGLISH, "es": SPANISH}


def map_literal(entries: dict) -> str:
    """SQL map literal of words to texts or numbers; one parse instead of many calls."""
    def sql(x):
        return f"{x!r}D" if isinstance(x, float) else '"' + x + '"'

    return "map(" + ", ".join(f"{sql(k)}, {sql(v)}" for k, v in entries.items()) + ")"


def by_language(lang: Column, build) -> Column:
    """Pick ``build(language)`` by a language column; anything unknown is English."""
    return F.when(lang == "es", build(SPANISH)).otherwise(build(ENGLISH))


def in_set(lang: Column, word: Column, attribute: str) -> Column:
    """``word`` belongs to the named word set of the row's language."""
    return by_language(lang, lambda t: word.isin(*getattr(t, attribute)))


def effective_language(configured: Column, detected: Column) -> Column:
    """The configured language, or for ``auto`` the detected one when supported."""
    return F.when(configured != "auto", configured).otherwise(
        F.when(detected.isin("en", "es"), detected).otherwise(F.lit("en"))
    )


# ---------------------------------------------------------------------------
# Table forms of the vocabulary

#: phrases up to which a vocabulary is sent to every executor
SMALL_VOCABULARY = 100_000


def lexicon_frame(spark: SparkSession) -> DataFrame:
    """The vocabulary as rows ``(lang, class, phrase, n_tokens, canonical, value)``."""
    rows = []

    def add(t, kind, entries, canonical=None, value=None):
        for p in entries:
            rows.append((
                t.code, kind, p, len(p.split()),
                canonical.get(p) if canonical else None,
                value.get(p) if value else None,
            ))

    for t in LANGUAGES.values():
        for kind in (
            "nouns", "kept_nouns", "preps", "articles", "hundred", "dozen", "half",
            "connectors", "number_articles", "approx", "of", "confirm", "reject", "scratch",
            "negation", "is_words", "change", "to_words", "conjunctions",
        ):
            add(t, kind, getattr(t, kind))
        for kind in ("ones", "tens", "hundreds", "big", "vague"):
            table = getattr(t, kind)
            add(t, kind, table, value=table)
        add(t, "unit", t.units, canonical=t.units)
        add(t, "field", t.fields, canonical=t.fields)
    return spark.createDataFrame(
        rows,
        "lang string, class string, phrase string, n_tokens int, canonical string, value double",
    )


def match_phrases(df: DataFrame, lexicon: DataFrame, key: str, tokens: str = "tokens",
                  lang: str = "lang") -> DataFrame:
    """Longest vocabulary phrase of every class at each token: ``(key, pos, class, n_tokens)``.

    Runs of as many tokens as the longest phrase join the vocabulary on language
    and text. The vocabulary is the side that is broadcast or hashed, by its counted
    rows: the runs are many times what Spark estimates from the files they come from.
    """
    words_at = F.col(tokens)
    longest, phrases = lexicon.agg(F.max("n_tokens"), F.count("*")).first()
    longest = longest or 1
    grams = df.select(
        key, lang,
        F.explode(F.flatten(F.transform(words_at, lambda t, i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words_at) - i)),
            lambda n: F.struct(i.alias("pos"), F.array_join(F.transform(
                F.slice(words_at, i + 1, n), lambda w: w["fold"]), " ").alias("phrase")),
        )))).alias("g")).select(key, F.col(lang).alias("_lang"), "g.pos", "g.phrase")
    vocabulary = lexicon.select(F.col("lang").alias("_lang"), "class", "phrase", "n_tokens").hint(
        "broadcast" if phrases <= SMALL_VOCABULARY else "shuffle_hash")
    return grams.join(vocabulary, ["_lang", "phrase"]).groupBy(key, "pos", "class").agg(
        F.max("n_tokens").alias("n_tokens"))


def unit_rows(units: DataFrame) -> DataFrame:
    """Backend unit rows as ``(lang, form, canonical)``; empty language is every language."""
    canonical = fold(trim_space("name"))
    forms = F.explode(F.concat(F.array(canonical), F.transform(
        F.coalesce(F.col("aliases"), F.array().cast("array<string>")),
        lambda a: fold(trim_space(a)),
    )))
    return (
        units.where(canonical != "")
        .select(F.coalesce("language", F.lit("")).alias("lang"), "name",
                canonical.alias("canonical"), forms.alias("form"))
        .where("form != ''")
    )


def unit_forms(units: DataFrame) -> DataFrame:
    """Backend units as ``(_ul, _uf, _canonical)``: one row per language and spoken form.

    A neutral row counts for both languages; the last row by name wins a form.
    """
    table = unit_rows(units).select(
        F.explode(F.when(F.col("lang") == "", F.array(F.lit("en"), F.lit("es")))
                  .otherwise(F.array("lang"))).alias("_ul"), "name", "form", "canonical")
    return table.groupBy("_ul", F.col("form").alias("_uf")).agg(
        F.max_by("canonical", "name").alias("_canonical"))


def builtin_unit(lang: Column, word: Column) -> Column:
    """The canonical unit of a folded word in the language's own table, or null."""
    return by_language(lang, lambda t: F.try_element_at(F.expr(map_literal(t.units)), word))


def unit_lookup(words_df: DataFrame, units: DataFrame, word="word", lang="lang") -> DataFrame:
    """Add ``canonical_unit`` to rows of folded words.

    The built-in table of the language answers first; other words are looked up
    in the backend units of that language or of all languages.
    """
    row_lang = F.when(F.col(lang) == "es", "es").otherwise("en")
    return (
        words_df.withColumn("_rl", row_lang)
        .join(unit_forms(units), (F.col("_rl") == F.col("_ul")) & (F.col(word) == F.col("_uf")), "left")
        .withColumn("canonical_unit", F.coalesce(builtin_unit(F.col(lang), F.col(word)), "_canonical"))
        .drop("_rl", "_ul", "_uf", "_canonical")
    )
