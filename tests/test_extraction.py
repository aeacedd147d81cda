"""Golden utterances, number words, commands and tokens."""

from pyspark.sql import functions as F

from tallyline.operators import extraction as ex
from tallyline.operators.tokens import tokenize

# lang | text | quantity | unit | item | location | description
GOLDEN = """en|Twelve boxes of RJ45 connectors in bin A-14|12|boxes|RJ45 connectors|A-14|
en|Bin C-7, forty spools of Cat6, three have water damage|40|spools|Cat6|C-7|three have water damage
en|About a dozen assorted brackets, aisle five shelf two|12||assorted brackets|aisle 5 / shelf 2|
en|three bags of washers in bin a 14|3|bags|washers|A-14|
en|a hundred feet of half inch conduit in rack 12|100|feet|half inch conduit|rack 12|
en|two dozen safety glasses on shelf 3|24||safety glasses|shelf 3|
en|one pallet of paper towels in dock 2|1|pallet|paper towels|dock 2|
en|forty boxes in bin A-14|40||boxes|A-14|
en|sixty five feet of Cat6 cable, bin B-9|65|feet|Cat6 cable|B-9|
en|empty bin D-4|||empty|D-4|
en|five hundred hex bolts in bin E-1, some are rusty|500||hex bolts|E-1|some are rusty
en|Twelve boxes of RJ45 in bin A-40, no, A-14|12|boxes|RJ45|A-14|
en|roughly two hundred zip ties, zone 4|200||zip ties|zone 4|
es|doce cajas de conectores RJ45 en el bin A-14|12|cajas|conectores RJ45|A-14|
es|Bin C-7, cuarenta carretes de Cat6, tres tienen daño de agua|40|carretes|Cat6|C-7|tres tienen daño de agua
es|una docena de soportes surtidos, pasillo cinco estante dos|12||soportes surtidos|pasillo 5 / estante 2|
es|unos cuarenta tubos en el pasillo tres|40||tubos|pasillo 3|
es|cien metros de cable Cat6 en la zona 4|100|metros|cable Cat6|zona 4|
es|dos mil quinientas arandelas en el bin F-2|2500||arandelas|F-2|
es|media docena de guantes en el estante uno|6||guantes|estante 1|
es|doce cajas de tornillos en el bin A-40, digo, A-14|12|cajas|tornillos|A-14|
en|several boxes of hinges in bin B-2||boxes|hinges|B-2|
en|five skids of cement in bay 3|5|skids|cement|bay 3|
en|a box of nails on shelf 4|1|box|nails|shelf 4|
en|forty spools of Cat6 in bin A-14 near the door|40|spools|Cat6|A-14|near the door
en|two reels of wire in bin c7|2|reels|wire|C-7|
en|damaged stuff, twelve boxes of RJ45 connectors in bin A-14|12|boxes|RJ45 connectors|A-14|damaged stuff
en||||||
en|Twelve boxes of RJ45 in bin A-14, I mean fifteen|15|boxes|RJ45|A-14|
en|forty spools of Cat6 in C-7, no water damage|40|spools|Cat6|C-7|no water damage
en|nails in bin A - 14|||nails|A-14|
en|several hundred bolts in bin B-2|||bolts|B-2|
en|forty tubes in aisle 3, no, fifty reels|50|reels||aisle 3|
en|Twelve boxes of RJ45 in bin A-14, no, about fifteen|15|boxes|RJ45|A-14|"""

# lang | text | spans, ~ approximate, None vague
NUMBERS = """en|forty two|42
en|half a dozen|6
en|one hundred and five|105
en|twenty five hundred|2500
en|three thousand two hundred and ten|3210
en|about forty|40~
en|a couple|2~
en|several|None~
en|some forty|40~
en|12.5|12.5
en|1,200|1200
en|3 dozen|36
en|aisle five shelf two|5 2
en|a box|
en|and|
en|five twenty|5 20
en|twenty five and six|25 6
en|zero thousand|0 1000
en|two thousand a hundred|2100
en|a couple hundred|200~
en|a couple five|5
en|some hundred|None~
es|cuarenta y dos|42
es|veintidós|22
es|dos mil quinientos cuarenta y dos|2542
es|media docena|6
es|un par|2~
es|un par cinco|1 5
es|treinta un par|31
es|más o menos diez|10~
es|12,5|12.5
es|la caja|"""

# text | lang | kind | field | value
COMMANDS = """yes correct|en|confirm||
sí|es|confirm||
scratch that|en|scratch||
borra eso|es|scratch||
no|en|reject||
wrong|en|reject||
location is A-40|en|set_field|location|A-40
the location is A-40|en|set_field|location|A-40
change quantity to 15|en|set_field|quantity|15
quantity is fifteen|en|set_field|quantity|fifteen
la ubicación es B-2|es|set_field|location|B-2
cambia la cantidad a quince|es|set_field|quantity|quince
no, A-14|en|set_field|location|A-14
no, fifteen|en|set_field|quantity|15
no, about fifteen|en|set_field|quantity|15
twelve boxes of RJ45 in A-14|en|||
|en|||"""


def _rows(text):
    return [tuple(line.split("|")) for line in text.split("\n")]


def _frame(spark, text, schema):
    return spark.createDataFrame(_rows(text), schema).coalesce(1)


def test_golden_slots(spark):
    df = _frame(spark, GOLDEN, "lang string, text string, q string, u string, i string, l string, d string")
    for r in ex.extract(df).collect():
        p = r.parse
        got = ("" if p.quantity is None else f"{p.quantity:g}", p.unit or "", p.item_text,
               p.location_text, p.description or "")
        assert got == (r.q, r.u, r.i, r.l, r.d), r.text


def test_filter_on_result_stays_above_extraction(spark):
    df = _frame(spark, GOLDEN, "lang string, text string, q string, u string, i string, l string, d string")
    want = sum(row[5] == "A-14" for row in _rows(GOLDEN))
    assert ex.extract(df).where("parse.location_text = 'A-14'").count() == want


def test_number_words(spark):
    df = _frame(spark, NUMBERS, "lang string, text string, want string")
    for r in ex.scan_numbers(df).collect():
        got = " ".join(("None" if n.value is None else f"{n.value:g}") + ("~" if n.approx else "")
                       for n in r.numbers)
        assert got == r.want, r.text


def test_number_span(spark):
    df = spark.createDataFrame([("about a dozen assorted brackets", "en")], "text string, lang string")
    n = ex.scan_numbers(df).first().numbers[0]
    assert (n.mark_start, n.start, n.end) == (0, 1, 3)


def test_commands(spark):
    df = _frame(spark, COMMANDS, "text string, lang string, k string, f string, v string")
    for r in ex.commands(df).collect():
        c = r.command
        got = (c.kind, c.field or "", c.value or "") if c else ("", "", "")
        assert got == (r.k, r.f, r.v), r.text


def test_tokens(spark):
    texts = ["Bin C-7, forty spools.", "forty-two a-14", "1,200, more", "hello — world", " , "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: [(t.fold, t.clause_end) for t in r.tokens] for r in tokenize(df).collect()}
    assert got[texts[0]] == [("bin", False), ("c-7", True), ("forty", False), ("spools", True)]
    assert got[texts[1]] == [("forty", False), ("two", False), ("a-14", True)]
    assert got[texts[2]] == [("1,200", True), ("more", True)]
    assert got[texts[3]] == [("hello", True), ("world", True)]
    assert got[texts[4]] == []


def test_multi_item(spark):
    df = spark.createDataFrame([
        (0, "twelve boxes of RJ45 in bin A-14 and three reels of Cat6", "en"),
        (1, "forty spools of Cat6 in C-7, three are wet and two are missing ends", "en"),
    ], "utt long, text string, lang string")
    rows = ex.extract_items(df, "utt").orderBy("utt", "item_no").collect()
    got = [(r.utt, r.parse.quantity, r.parse.item_text, r.parse.location_text) for r in rows]
    assert got == [(0, 12.0, "RJ45", "A-14"), (0, 3.0, "Cat6", "A-14"), (1, 40.0, "Cat6", "C-7")]


def test_extra_units(spark):
    df = spark.createDataFrame([("five skids cement in bay 3", "en")], "text string, lang string")
    p = ex.extract(df, extra_units=["skids"]).first().parse
    assert (p.unit, p.item_text) == ("skids", "cement")


def test_spoken_values(spark):
    v = spark.createDataFrame([("bin a 14", "en"), ("the back corner", "en"), ("about forty", "en"),
                               ("banana", "en")], "value string, lang string").coalesce(1)
    assert [r.location_text for r in ex.location_value(v).collect()] == [
        "A-14", "the back corner", "about forty", "banana"]
    assert [(r.quantity, r.quantity_approx) for r in ex.quantity_value(v).collect()][2:] == [
        (40.0, True), (None, None)]
