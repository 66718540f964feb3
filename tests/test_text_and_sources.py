"""Text rules, classifier traps and markup quirks."""

import pytest
from pyspark.sql import functions as F

from pricelens.functions import text as tx
from pricelens.functions.parse import price_text_cents, topic_price
from pricelens.operators import classify_drives as dr
from pricelens.operators import classify_pc as pc
from pricelens.operators.profiles import PROFILES
from pricelens.operators.scoring import per_unit_cents
from pricelens.plans.title_cases import PC_CFG
from pricelens.sources import cards as cd
from pricelens.sources import forum as fo
from pricelens.sources.registry import unread_pages


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_normalize_native_equals_exact(spark):
    words = ["Étagère “neuve”  — l’été", "½ ﬁn … ™ №5", "ÇÀ et\tlà\n", "Straße ŒUVRE", "été", None, "2″ x", "a''b", "𝗗𝗶𝘀𝗾𝘂𝗲 𝟴𝗧𝗼", "8 ㎇", "한국어 텍스트", "ﷺ"]
    native = column(spark, words, tx.normalize_text)
    assert native == [tx.normalized(w or "") for w in words]
    assert native[0] == 'etagere "neuve" - l\'ete' and native[5] == ""


def test_folding_covers_every_plane(spark):
    codes = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and tx.fold(chr(c)) != chr(c)]
    words = ["".join(map(chr, codes[i:i + 400])) for i in range(0, len(codes), 400)]
    assert column(spark, words, tx.strip_marks) == [tx.fold(w) for w in words]


def test_floor_of_a_cpu():
    assert pc.cpu_floor("i5 8e gen") == pc.cpu_floor("i5-8400") == 10 and pc.cpu_floor("") is None
    with pytest.raises(ValueError):
        pc.cpu_floor("un bon processeur")


def test_rejected_rows_keep_what_was_found(spark):
    rows = spark.createDataFrame([("Optiplex 3020 i3-4130 8 Go", "", "used")], "title string, description string, condition_code string")
    row = pc.classify_pc(rows, PC_CFG).first()
    assert row.reason.startswith("cpu_below") and row.attrs["cpu"] == "i3-4130" and row.flags == ["family_unknown"]
    rows = spark.createDataFrame([("Disque dur 4 To", "", "used")], "title string, description string, condition_code string")
    assert dr.classify_drives(rows, {}).first().attrs == {"capacities_gb": "4000"}


def test_settings_may_be_fractions(spark):
    assert PROFILES["hdd"].scoring({"target_capacity_tb": 1.92})["unit_divisor"] == 1.92
    assert column(spark, ["100"], lambda c: per_unit_cents(c.cast("bigint"), F.lit(0.5))) == [200]


def test_pages_of_unknown_sources_are_told(spark):
    pages = spark.createDataFrame([("w", "mars", "<p>"), ("w", "ebay", "{}"), ("w", "hfr", "x"), ("w", None, "x")], "watch string, source string, body string")
    assert {(r.source, r.error) for r in unread_pages(pages).collect()} == {("mars", "unknown source: mars"), ("hfr", "no url"), (None, "unknown source: null")}


def test_negation(spark):
    words = ["disque hs", "aucun hs", "secteurs defectueux : 0", "aucun secteur defectueux", "piano hs", "10 hs", "hs: 01", "sans hs mais hs", "chs"]
    got = column(spark, words, lambda c: tx.find_affirmed_keyword(c, ["hs", "defectueux", "secteur defectueux", "secteurs defectueux"]))
    # Negation words have no left boundary: "piano" and "10" negate as well.
    assert got == ["hs", None, None, None, None, None, "hs", "hs", None]


def test_lot_variants_differ_out_of_range(spark):
    titles = ["lot de 40 pour 3 drives", "lot de 99 puis 3 pcs"]
    assert column(spark, titles, dr.drive_lot_quantity) == [3, 3]
    assert column(spark, titles, pc.pc_lot_quantity) == [40, 1]


def test_memory_contexts(spark):
    texts = ["16 go 256 go ssd", "ram 8go - ssd 500 go", "ssd 32 go ddr4 64 go", "1 to", "64 go 64 go", "512 go"]
    got = column(spark, texts, pc.memory)
    assert [(m.ram, m.storage) for m in got] == [(16, 256), (8, 500), (64, None), (None, 1000), (64, None), (None, 512)]


def test_pc_floor():
    assert pc.cpu_floor("i5-8400") == 10 and pc.cpu_floor(PC_CFG["min_cpu"]) == 12 and pc.cpu_floor("") is None


def test_prices(spark):
    assert column(spark, ["1 099,00", "1.300,50", "1,300.50", "1300.00", "", "abc", "1 099,5"], price_text_cents) == [
        109900, 130050, 130050, 130000, None, None, 109950]
    assert column(spark, ["Prix: 1 050€out", "650 euros", "Prix : 700", "0 €", "x", "12,50 €"], topic_price) == [1050, 650, 700, None, None, 12]


CARD = '<a href="/items/7-x?r=1" data-testid="product-item-id-7--overlay-link" title="{}"></a>'


def test_cards(spark):
    titles = ["Rtx, 24Go, comme neuve, Marque: N&amp;V, Taille: M, État: Neuf sans étiquette, 1 099,00 €, 1 154,65 €", "Sans prix", "Simple, 5 €"]
    pages = spark.createDataFrame([(i, CARD.format(t)) for i, t in enumerate(titles)], "page_id int, body string")
    a, b = cd.card_listings(pages).orderBy("page_id").collect()
    assert (a.title, a.price_cents, a.fees_cents, a.brand, a.condition_code, a.url) == (
        "Rtx, 24Go, comme neuve", 109900, 5565, "N&V", "new", "https://www.vinted.fr/items/7-x")
    assert (b.title, b.price_cents, b.fees_cents, b.condition_code) == ("Simple", 500, 0, "unknown")


def test_item_page(spark):
    body = ('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Product","description":"Testée",'
            '"offers":{"availability":"InStock"}}</script><script>x("{\\"is_reserved\\":true},{\\"feedback_reputation\\":0.96,\\"feedback_count\\":74}")</script>')
    r = cd.item_details(spark.createDataFrame([(1, body)], "id int, body string")).collect()[0]
    assert (r.description, r.status, r.seller_rating, r.seller_reviews) == ("Testée", "pending", 96.0, 74)


def test_opening_post_and_price(spark):
    body = ('<table class="messagetable"><tr><td class="messCase1"><b>v</b> Transactions (54)</td><td><div id="para9"><p>Ventes</p>'
            '<div><table class="quote"><tr><td><p>Prix 999 €</p></td></tr></table></div><p>Je vends ma carte verte<br>Bon état</p>'
            "<p>55€ out, 60€ in</p><p>-----------</p><p><s>Boîtier <b>blanc</b> 90€</s> 80€out</p><p>Envoi possible</p></div></td></tr></table>"
            '<table class="messagetable"><tr><td><div id="para2">Dispo à 9 € ?</div></td></tr></table>')
    posts = fo.opening_posts(spark.createDataFrame([(1, body), (2, "<p>none</p>")], "page_id int, body string"))
    rows = posts.collect()
    assert len(rows) == 1 and rows[0].transactions == 54
    assert rows[0].lines == ["Ventes", "Je vends ma carte verte", "Bon état", "55€ out, 60€ in", "-----------", "~~Boîtier blanc 90€~~ 80€out", "Envoi possible"]
    topic = posts.select("page_id", "lines", "transactions", F.lit("3").alias("topic_id"), F.lit("[VDS] carte").alias("title"), F.lit("u").alias("url"),
                         F.lit("v").alias("author"), F.lit(None).cast("timestamp").alias("last_post"), F.lit(None).cast("bigint").alias("replies"))
    found = fo.topic_listings(fo.item_block(topic.withColumn("query_no", F.lit(0)), ["carte verte"])).collect()[0]
    assert (found.price_cents, found.shipping_cents, found.status, found.delivery, found.seller_reviews) == (5500, 500, "active", True, 54)
    case = fo.topic_listings(fo.item_block(topic.withColumn("query_no", F.lit(0)), ["blanc"])).collect()[0]
    assert case.price_cents == 8000 and case.status == "active"
