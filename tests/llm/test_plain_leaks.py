from test_duplicates import prose

from tideledger.llm import decontaminate

SUM = "a shepherd near the village keeps 12 sheep and later buys 30 goats at the yearly market"
NAMES = "when did the painter Alice Brown visit her old friend Bernard at the coast for the last time before the war started there again"
BARE = "Anna 12 Bernard 30 Clara 45 Dora 60 Emil"


def test_leaks_that_only_a_plain_comparison_or_equal_values_show(spark, documents):
    benchmark = spark.createDataFrame([(1, SUM), (2, NAMES), (3, BARE)], "item_id bigint, text string")
    put = lambda text, seed: f"{prose(60, seed)} {text} {prose(60, seed + 1)}"
    rows = [
        (1, put(SUM.replace("12", "7").replace("30", "7"), 800)), (2, put(NAMES.lower(), 802)), (3, put(NAMES.upper(), 804)),
        (4, put(BARE, 806)), (5, put(BARE.upper(), 808)), (6, put(BARE.replace("30", "31").replace("Dora", "Ida"), 810)), (7, put(NAMES.replace("Alice", "Maria"), 812)),
    ]
    out = decontaminate.leaks(documents(rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (7, 2)]
    by = {r.doc_id: r for r in out}
    assert by[1].changed and not by[2].changed and by[2].similarity == by[3].similarity == 1.0 and by[4].start == 60
