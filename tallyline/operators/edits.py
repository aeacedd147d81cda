"""Field edits of stored records and re-dictation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import format_quantity, trim_space
from tallyline.operators.extraction import extract, location_value, per_text, quantity_value
from tallyline.operators.resolve import has_rows, resolve, resolve_parse
from tallyline.operators.review import capture_reasons, confidence, edit_reasons, with_profile
from tallyline.session import cut_lineage


def _understand(e: DataFrame, locations: DataFrame, parts: DataFrame) -> DataFrame:
    """Add what the typed or spoken ``value`` of each edit says: text, id and score of its field."""
    e = e.withColumns({"_lang": F.coalesce("language", F.lit("en")),
                       "_trim": trim_space(F.coalesce("value", F.lit("")))})
    # each different value is parsed and resolved once: most edits of a field say what others said

    def place(t: DataFrame, said: str, lang: str) -> DataFrame:
        t = location_value(t, said, lang, "_lt").withColumn("_lt0", F.coalesce("_lt", F.lit("")))
        return resolve(t, "_lt0", locations, "id", "_lid", "_ls", code=True).drop("_lt0")

    def number(t: DataFrame, said: str, lang: str) -> DataFrame:
        return quantity_value(t, said, lang, "_q")

    def item(t: DataFrame, said: str, lang: str) -> DataFrame:
        return resolve(t, said, parts, "part_number", "_pid", "_ps", code=False)

    # an edit goes through the rules of its own field only
    out = e.where(~F.coalesce(F.col("field").isin("location", "quantity", "item"), F.lit(False)))
    for field, value, work in (("location", "value", place), ("quantity", "value", number), ("item", "_trim", item)):
        out = out.unionByName(
            per_text(e.where(F.col("field") == field), work, value, "_lang"), allowMissingColumns=True)
    return out


def _understood(field: Column) -> Column:
    return (
        F.when(field == "location", F.coalesce("_lt", F.lit("")) != "")
        .when(field == "quantity", F.col("_q").isNotNull())
        .when(field.isin("unit", "item"), F.col("_trim") != "")
        .otherwise(field == "description")
    )


def apply_edits(records: DataFrame, edits: DataFrame, locations: DataFrame, parts: DataFrame,
                profiles: DataFrame | None = None) -> DataFrame:
    """Outcome of one edit ``(id, field, value, at)`` per record.

    Adds ``outcome``, the edited ``parsed`` and ``confidence``, the
    ``correction`` to log and the review state. Edited confidence is not
    multiplied by speech confidence.
    """
    e = cut_lineage(edits.join(records.select(
        "id", "device_id", "language", "status", "parsed", "confidence"), "id", "left"))
    e = _understand(e, locations, parts)
    field, p, c = F.col("field"), F.col("parsed"), F.col("confidence")
    outcome = (
        F.when(p.isNull(), "not_found").when(~_understood(field), "not_understood")
        .when(~F.col("status").isin("draft", "confirmed"), "immutable").otherwise("applied")
    )
    unit = F.lower("_trim")
    new = p
    for name, on, value in (
        ("location_text", "location", F.col("_lt")), ("location_id", "location", F.col("_lid")),
        ("quantity", "quantity", F.col("_q")), ("unit", "unit", unit),
        ("item_text", "item", F.col("_trim")), ("part_number", "item", F.col("_pid")),
        ("description", "description", F.when(F.col("_trim") != "", F.col("_trim"))),
    ):
        new = new.withField(name, F.when(field == on, value).otherwise(p[name]))
    conf = (
        c.withField("location", F.when(field == "location", F.coalesce("_ls", F.lit(0.9)))
                    .otherwise(c["location"]))
        .withField("quantity", F.when(field == "quantity", F.when(
            F.col("_q_approx"), 0.5).otherwise(0.95)).otherwise(c["quantity"]))
        .withField("item", F.when(field == "item", F.coalesce("_ps", F.lit(0.9)))
                   .otherwise(c["item"]))
    )
    before = (
        F.when(field == "location", p["location_text"])
        .when(field == "quantity", format_quantity(p["quantity"]))
        .when(field == "unit", F.coalesce(p["unit"], F.lit("")))
        .when(field == "item", p["item_text"])
        .otherwise(F.coalesce(p["description"], F.lit("")))
    )
    after = (
        F.when(field == "location", F.col("_lt")).when(field == "quantity", format_quantity("_q"))
        .when(field == "unit", unit).otherwise(F.col("_trim"))
    )
    e = e.withColumn("outcome", outcome)
    ok = F.col("outcome") == "applied"
    e = e.withColumns({
        "correction": F.when(ok, F.struct(
            field.alias("field"), before.alias("from"), after.alias("to"), F.col("at"))),
        "_np": F.when(ok, new), "_nc": F.when(ok, conf),
    }).drop("parsed", "confidence")
    e = e.withColumnsRenamed({"_np": "parsed", "_nc": "confidence"})
    keep = [x for x in e.columns if not x.startswith("_")]
    e = with_profile(e.select(*keep), profiles)
    e = e.withColumn("review_reasons", F.when(
        F.col("outcome") == "applied", edit_reasons(F.col("parsed"), F.col("confidence"))))
    return e.withColumn("needs_review", F.size("review_reasons") > 0).select(
        *keep, "review_reasons", "needs_review")


# --- several edits of one record ---------------------------------------------

#: the field name of an edit whose value is a new utterance of the whole record
DICTATION = "dictation"
_SAID = ("location_text", "location_id", "quantity", "unit", "item_text", "part_number", "description")
#: what each field's edit replaces
_REPLACES = {"location": ("location_text", "location_id"), "quantity": ("quantity",), "unit": ("unit",),
             "item": ("item_text", "part_number"), "description": ("description",)}


def _effects(e: DataFrame, locations: DataFrame, parts: DataFrame) -> DataFrame:
    """What each edit says, whatever its record holds: ``(id, edit)``.

    Texts are parsed and resolved here, once for all edits; folding them needs no more than this.
    """
    typed = _understand(e.where(F.col("field") != DICTATION), locations, parts)
    score = {"location": F.coalesce("_ls", F.lit(0.9)), "quantity": F.when(F.col("_q_approx"), 0.5).otherwise(0.95),
             "item": F.coalesce("_ps", F.lit(0.9))}
    none = F.lit(None)

    def edit(ok: Column, said: list[Column], sure: list[Column], vague: Column) -> Column:
        types = ["string", "string", "double", "string", "string", "string", "string"]
        return F.struct(
            "at", "pos", "field", ok.alias("ok"),
            F.struct(*[v.cast(t).alias(n) for n, v, t in zip(_SAID, said, types)]).alias("said"),
            F.struct(*[v.cast("double").alias(n) for n, v in zip(("asr", "quantity", "location", "item"), sure)]).alias(
                "sure"), vague.alias("vague")).alias("edit")

    short = typed.select("id", edit(
        F.coalesce(_understood(F.col("field")), F.lit(False)),
        [F.col("_lt"), F.col("_lid"), F.col("_q"), F.lower("_trim"), F.col("_trim"), F.col("_pid"),
         F.when(F.col("_trim") != "", F.col("_trim"))],
        [none, score["quantity"], score["location"], score["item"]], F.lit(False)))
    spoken = e.where(F.col("field") == DICTATION).select(
        "id", "at", "pos", "field", F.coalesce("language", F.lit("en")).alias("lang"),
        F.coalesce("value", F.lit("")).alias("text"), F.coalesce("asr_confidence", F.lit(1.0)).alias("asr"))
    heard = per_text(spoken, lambda t, said, lang: resolve_parse(
        cut_lineage(extract(t, said, lang)), locations, parts))
    p = F.col("parse")
    sure = confidence(p["cert_quantity"], p["cert_location"], p["cert_item"], F.col("asr"))
    whole = heard.withColumn("_c", sure).select("id", edit(
        F.lit(True), [p[n] for n in _SAID], [F.col("_c")[n] for n in ("asr", "quantity", "location", "item")],
        p["quantity_vague"]))
    return short.unionAll(whole)


def _fold(s: Column, e: Column, mutable: Column) -> Column:
    """The record after one more edit: it sees what earlier ones left."""
    p, c, field = s["parsed"], s["confidence"], e["field"]
    whole = field == DICTATION

    def replaced(old: Column, by: str, names) -> Column:
        for name in names:
            old = old.withField(name, e[by][name])
        return old

    # one branch is computed per edit, that of its field
    new = F.when(whole, replaced(p, "said", _SAID))
    for name, names in _REPLACES.items():
        new = new.when(field == name, replaced(p, "said", names))
    new = new.otherwise(p)
    scored = ("asr", "quantity", "location", "item")
    sure = F.when(whole, replaced(c, "sure", scored))
    for name in scored:
        sure = sure.when(field == name, replaced(c, "sure", (name,)))
    sure = sure.otherwise(c)

    def shown(v: Column, name: str) -> Column:
        return {"location": v["location_text"], "quantity": format_quantity(v["quantity"]),
                "item": v["item_text"]}.get(name, F.coalesce(v[name], F.lit(""))
                                            if name in ("unit", "description") else None)

    def change(name: str) -> Column:
        return F.struct(F.lit(name).alias("field"), shown(p, name).alias("from"), shown(e["said"], name).alias("to"),
                        e["at"].alias("at"))

    # an edit is always logged, a new dictation only where it says something else
    spoken = F.filter(F.array(*map(change, ("item", "quantity", "location"))), lambda x: x["from"] != x["to"])
    logged = F.when(whole, spoken)
    for name in _REPLACES:
        logged = logged.when(field == name, F.array(change(name)))
    outcome = F.when(~e["ok"], "not_understood").when(~mutable, "immutable").otherwise("applied")
    return F.get(F.transform(F.array(outcome), lambda o: F.struct(
        F.when(o == "applied", new).otherwise(p).alias("parsed"),
        F.when(o == "applied", sure).otherwise(c).alias("confidence"),
        F.when(o == "applied", F.concat(s["corrections"], logged)).otherwise(
            s["corrections"]).alias("corrections"),
        F.concat(s["outcomes"], F.array(o)).alias("outcomes"),
        F.when(o == "applied", whole).otherwise(s["dictated"]).alias("dictated"),
        F.when(o == "applied", e["vague"]).otherwise(s["vague"]).alias("vague"))), F.lit(0))


def apply_edit_log(records: DataFrame, edits: DataFrame, locations: DataFrame, parts: DataFrame,
                   profiles: DataFrame | None = None) -> DataFrame:
    """Records after all of their edits ``(id, field, value, at, pos, asr_confidence)``, in order of ``(at, pos)``.

    A record's edits are folded over the whole record, so each sees what the one before left: the
    log's ``from`` is the value then, and a ``dictation`` replaces all fields and all confidence. Texts
    are parsed and resolved before the fold, in one pass over all edits. A record's
    edits are bounded by what a person makes; nothing else is gathered.

    Gives one row per edited id: ``id``, ``outcomes`` (one per edit), ``corrections`` to log, and the
    record's ``parsed``, ``confidence``, ``review_reasons`` and ``needs_review`` after the last edit. Reasons
    follow the rules of a capture if a dictation came last, else those of an edit. An id without a
    record has outcome ``not_found`` per edit and nulls.
    """
    of_record = records.select("id", "device_id", "status", "language", "parsed", "confidence", "review_reasons",
                               "needs_review")
    known = cut_lineage(edits.join(of_record.select("id", "language"), "id", "left"))
    order = F.array_sort(F.collect_list("edit"))  # by at, then pos
    # written once: the parse is a long plan, and the fold need not be planned again with it
    found = (cut_lineage(_effects(known, locations, parts)).groupBy("id").agg(order.alias("edits"))
             .join(of_record, "id", "left"))
    log = F.array().cast("array<struct<field:string,from:string,to:string,at:timestamp>>")
    start = F.struct("parsed", "confidence", log.alias("corrections"), F.array().cast("array<string>").alias("outcomes"),
                     F.lit(False).alias("dictated"), F.lit(False).alias("vague"))
    mutable = F.col("status").isin("draft", "confirmed")
    folded = F.when(F.col("status").isNotNull(), F.aggregate("edits", start, lambda s, e: _fold(s, e, mutable)))
    df = with_profile(found.withColumn("_s", folded), profiles)
    s = F.col("_s")
    p, c = s["parsed"], s["confidence"]
    reasons = F.when(~F.array_contains(s["outcomes"], "applied"), F.col("review_reasons")).when(
        s["dictated"], capture_reasons(p, c, s["vague"], F.lit(False), has_rows(locations), has_rows(parts))
    ).otherwise(edit_reasons(p, c))
    df = df.withColumn("_reasons", F.when(s.isNotNull(), reasons))
    return df.select(
        "id", F.coalesce(s["outcomes"], F.transform("edits", lambda e: F.lit("not_found"))).alias("outcomes"),
        s["corrections"].alias("corrections"), p.alias("parsed"), c.alias("confidence"),
        F.col("_reasons").alias("review_reasons"),
        F.when(F.array_contains(s["outcomes"], "applied"), F.size("_reasons") > 0).otherwise(
            F.col("needs_review")).alias("needs_review"))


def redictation_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Corrections a new dictation of the same record implies, one row per change.

    Both sides are ``(id, item_text, quantity, location_text)``; ``new`` also
    carries ``at``.
    """
    o = old.select("id", *[F.col(c).alias(f"_o_{c}") for c in ("item_text", "quantity", "location_text")])
    j = new.join(o, "id")

    def change(name, before, after):
        return F.struct(F.lit(name).alias("field"), before.alias("from_value"),
                        after.alias("to_value"))

    return j.select("id", "at", F.explode(F.array(
        change("item", F.col("_o_item_text"), F.col("item_text")),
        change("quantity", format_quantity("_o_quantity"), format_quantity("quantity")),
        change("location", F.col("_o_location_text"), F.col("location_text")),
    )).alias("c")).select("id", "c.*", "at").where("from_value != to_value")


def manual_entries(typed: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Records of typed fields: full confidence, English unless en or es is given."""
    one = F.lit(1.0)
    df = with_profile(typed, profiles).withColumns({
        "language": F.when(F.col("language").isin("en", "es"), F.col("language")).otherwise("en"),
        "confidence": F.struct(one.alias("asr"), one.alias("quantity"), one.alias("location"),
                               one.alias("item")),
    })
    df = df.withColumn("review_reasons", edit_reasons(F.col("parsed"), F.col("confidence")))
    return df.withColumns({
        "needs_review": F.size("review_reasons") > 0,
        "status": F.when(F.col("confirm"), "confirmed").otherwise("draft"),
    })
