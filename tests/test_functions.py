"""Function tables: input and expected value of each case, one DataFrame a function."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import keys, markup, titles, values


def apply(spark, f, rows, schema="a string"):
    """The function's value for each row, in order."""
    rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    columns = [F.col(c) for c in df.columns[1:]]
    return [r.x for r in df.select("i", f(*columns).alias("x")).orderBy("i").collect()]


def check(spark, f, cases, schema="a string"):
    assert apply(spark, f, [c for c, _ in cases], schema) == [want for _, want in cases]


def test_brand_key(spark):
    check(spark, keys.brand_key, [("d'Alba", "dalba"), ("e.l.f.", "elf"), (" COSRX ", "cosrx"), ("Dot & Key", "dotkey"), ("", ""), (None, ""), ("Kora Cosmetics", "koracosmetics")])


def test_normalize_gtin(spark):
    check(spark, keys.normalize_gtin, [
        ("8809416470009", "8809416470009"), (" 8809803586047 ", "8809803586047"), ("880-980-3532549", "8809803532549"), ("40170725", "40170725"), ("036000291452", "036000291452"), ("10614141000415", "10614141000415"),
        ("1157765", ""), ("B08XYZ1234", ""), ("8809416470008", ""), ("", ""), (None, ""), ("1" * 15, ""),
    ])


def test_plausible_barcode_and_sku(spark):
    check(spark, keys.plausible_barcode, [("8906118410545", True), ("9991308610002", False), ("2001234567893", False), ("", False), (None, False), ("036000291452", True)])
    check(spark, keys.gtin_from_sku, [("8800294993574", "8800294993574"), ("20714222857", "020714222857"), ("MPSS50", ""), ("12345678901", ""), (None, "")])


def test_attribute_gtin(spark):
    check(spark, keys.attribute_gtin, [
        ({"UPC": "8904417306224", "Item model number": "AQ-01"}, "8904417306224"), ({"Item model number": "8906087778462"}, "8906087778462"), ({"Manufacturer Part Number": "8904417306224"}, "8904417306224"),
        ({"Item model number": "11502012"}, ""), ({"Item model number": "992880990000"}, ""), ({"Item model number": "AQ-SUN-50G"}, ""), ({"Item model number": "1234567890123"}, ""), ({"ASIN": "B09TPFTJNN"}, ""), ({}, ""), (None, ""),
    ], "a map<string,string>")


def test_gtin_from_images(spark):
    check(spark, keys.gtin_from_images, [(["https://c.test/31/8906034883836_5.jpg"], "8906034883836"), (["https://c.test/HO2A1364.jpg"], ""), (["https://c.test/1234567890123_5.jpg"], ""), ([], ""), (None, ""), (["x", "https://c.test/8906034883836.png?v=1"], "8906034883836")], "a array<string>")


def test_ids(spark):
    check(spark, keys.manual_id, [((" S1 ", "B", "N"), "S1"), (("", "Dot & Key", "A  new/Name"), "manual-dotkey-a-new-name")], "a string, b string, c string")
    check(spark, keys.parent_id, [(("P", "/p/12", "x"), "P"), (("", "https://s.test/a/p/123?x", "x"), "123"), ((None, None, "x"), "x")], "a string, b string, c string")
    check(spark, keys.listing_code, [("https://s.test/dp/B09TPFTJNN/ref=1", "B09TPFTJNN"), ("https://s.test/dp/ABCDEFGHIJ", ""), ("https://s.test/x", "")])


@pytest.mark.parametrize("text, want", [("50 ml", (50, "ml", 1)), ("Serum (30ml)", (30, "ml", 1)), ("1 L Body Wash", (1000, "ml", 1)), ("Cream 50 g", (50, "g", 1)), ("2 x 50 ml", (50, "ml", 2)), ("Cleanser 125ml Pack of 2", (125, "ml", 2)), ("Face Serum", None), ("1,5 oz", (44.4, "ml", 1)), ("30 capsules", (30, "pc", 1)), (None, None)])
def test_parse_size(spark, text, want):
    [got] = apply(spark, titles.parse_size, [text])
    assert (tuple(got) if got else None) == want


def test_titles(spark):
    check(spark, lambda a, b: F.array_join(titles.name_tokens(a, b), " "), [(("Minimalist 10% Niacinamide Face Serum 30 ml Pack of 2", "Minimalist"), "face niacinamide serum"), ((None, None), "")], "a string, b string")
    check(spark, titles.detect_form, [("SPF 50 sunscreen", "sunscreen"), ("Face Wash", "cleanser"), ("Face Serum", "serum"), ("Deep Cleansing Balm", "cleansing_balm"), ("healing salve", "moisturizer"), ("ring", ""), (None, "")])
    check(spark, lambda a: titles.detect_form(a, whole_words=True), [("Barbecue", ""), ("soap bar", "soap")])
    check(spark, lambda a: F.array_join(titles.strengths(a), " "), [("10% Niacinamide", "pct10"), ("SPF 50 PA++++", "spf50"), ("0.50% and 0.5 %", "pct0.5"), ("", "")])
    check(spark, titles.is_bundle, [("Combo", True), ("Cream", False), ("set of 2", True)])
    check(spark, lambda a: titles.size_label(titles.parse_size(a)), [("2 x 50 ml", "2x50ml"), ("1.5 l", "1500ml"), ("none", "")])


def test_values(spark):
    check(spark, values.sheet_number, [("₹1,299.00", 1299.0), ("0", 0.0), ("-5", None), ("n/a", None), (None, None), ("1.2.3", None)])
    check(spark, values.payload_number, [("₹1,299.00", 1299.0), ("Rs -3.5 x", -3.5), ("", None), (None, None)])
    check(spark, values.short_count, [("14.9K ratings", 14900), ("1,234", 1234), ("2M", 2_000_000), ("none", None)])
    check(spark, lambda a: F.to_json(values.price_triple(a)), [("-30% ₹42000 M.R.P.: ₹59900", '{"selling_price":420.0,"mrp":599.0,"discount_pct":30.0}')])
    check(spark, values.boolean_word, [("In Stock", True), ("draft", False), ("maybe", None), (None, None)])
    check(spark, values.availability, [("http://schema.org/InStock", True), ("unavailable", False), ("available", True), ("OutOfStock", False), ("?", None)])
    check(spark, values.discount_pct, [((100.0, 75.0), 25.0), ((0.0, 0.0), None), ((50.0, 60.0), None), ((None, 1.0), None)], "a double, b double")
    check(spark, lambda a: F.date_format(values.instant(a), "yyyy-MM-dd HH"), [("2026-08-12T10:00:00Z", "2026-08-12 10"), ("2026-08-12T10:00:00+02:00", "2026-08-12 08"), ("2026-08-12", "2026-08-12 00"), ("nonsense", None), ("", None)])
    check(spark, lambda a: F.array_join(values.text_list(a), "|"), [([" a ", "", None, "b", "a"], "a|b"), (None, "")], "a array<string>")
    check(spark, values.is_unit_price, [("(₹12 / 100 ml)", True), ("₹120 per count", True), ("₹120", False)])


def test_markup(spark):
    check(spark, markup.html_to_text, [("<p>Hydrating <b>milk</b></p><script>x</script><p>a&amp;b</p>", "Hydrating milk\na&b"), (None, ""), ("plain", "plain")])
    check(spark, markup.html_to_text_native, [("<p>Hydrating <b>milk</b></p><script>x</script><p>a&amp;b</p>", "Hydrating milk\na&b"), (None, "")])
    check(spark, lambda a: F.array_join(markup.key_ingredients(a), "|"), [
        ("<p><b>Key Ingredients:</b></p><ul><li><b>Snail Filtrate:</b> Hydrates.</li><li><b>Sodium Hyaluronate (HA):</b> Plumps.</li></ul><p><b>Full Ingredient List:</b> Betaine</p>", "Snail Filtrate|Sodium Hyaluronate (HA)"),
        ("<p><b>Key Ingredients: </b>Niacinamide:Brightens skin tone.Panthenol:Moisturizes.</p>", "Niacinamide|Panthenol"), ("<p>Water, Glycerin</p>", ""), (None, ""),
    ])
    check(spark, lambda a: markup.content_sections(a)["how_to_use"], [("<h3>Ingredients</h3><p>Water.</p><h3>How To Use</h3><p>Rinse.</p>", "Rinse."), ("", "")])
    check(spark, lambda a: markup.labelled_section(a, "Ingredients", ("Ingredients", "Directions")), [("Ingredients: Water, Oil Directions: Rub", "Water, Oil"), ("none", "")])
    check(spark, lambda a: F.to_json(markup.attribute_table(a)), [("Brand: X\nUPC\t123\nBrand: Y\nnoise", '{"Brand":"X","UPC":"123"}')])
    check(spark, markup.brand_text, [("Visit the Minimalist Store", "Minimalist"), ("Brand: COSRX", "COSRX")])
    check(spark, lambda a: markup.absolute_url(a, "https://s.test/"), [("/p/1", "https://s.test/p/1"), ("//i.test/a", "https://i.test/a"), ("https://x", "https://x"), (None, "")])
    check(spark, lambda a: F.get_json_object(markup.linked_product(a), "$.offers.price"), [
        ('<script type="application/ld+json">{"@graph":[{"@type":"x"},{"@type":["Thing","http://schema.org/Product"],"offers":[{"price":5}]}]}</script>', "5"),
        ('<script type="application/ld+json">bad</script><script type="application/ld+json">[{"@type":"Product","offers":{"price":"7"}}]</script>', "7"), ("<html>", None),
    ])
    check(spark, lambda a: F.array_join(markup.media_list(a), "|"), [('[{"url":"https://a/1.jpg","mediaType":"image"},{"url":"https://a/2.mp4","mediaType":"video"},{"nested":{"src":"//b/3.jpg"}}]', "https://a/1.jpg|//b/3.jpg"), ("bad", "")])
    check(spark, lambda a: F.size(markup.record_array(a, ("response.products",))), [('{"response":{"products":[{"id":1},{"id":2}]}}', 2), ('{"data":{"list":[{"skuId":"a"}]}}', 1)])


def test_a_barcode_is_made_ready_once(spark):
    """Each text is stripped by one expression, not by one for each of its readers, and labels share one."""
    df = spark.createDataFrame([({"UPC": "8901030865275"}, " 890-1030865275"), ({"Item model number": "8901030865275", "EAN": "x"}, ""), ({}, None), (None, "1" * 20)], "a map<string,string>, g string")
    made = df.select(keys.attribute_gtin(F.col("a")).alias("a"), keys.normalize_gtin(F.col("g")).alias("g"))
    assert [tuple(r) for r in made.collect()] == [("8901030865275",) * 2, ("8901030865275", ""), ("", ""), ("", "")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 6


def test_a_title_is_read_once_by_each_pattern(spark):
    """Groups are read from what a pattern found, and short numbers lose their zeros without being formatted."""
    df = spark.createDataFrame([("2 x 50 ml pack of 3",), ("Pack of 3 1,5 L",), ("5gm (4-pack) 007.50% 0.0% + 10.% 1234567.125% 100%",), ("none",), (None,)], "t string")
    made = df.select(titles.parse_size(F.col("t")).alias("size"), F.array_join(titles.strengths(F.col("t")), " ").alias("strengths"))
    assert [(tuple(r.size) if r.size else None, r.strengths) for r in made.collect()] == [
        ((50.0, "ml", 2), ""), ((1500.0, "ml", 3), ""), ((5.0, "g", 4), "pct0 pct100 pct1234567.125 pct7.5"), (None, ""), (None, ""),
    ]
    assert made.select("size")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 12
