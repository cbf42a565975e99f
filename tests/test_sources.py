"""Adapters on small files, with exact expected rows."""

import pytest

from pyspark.sql import functions as F

from helpers import rows, short
from tideledger.functions import scalars as S
from tideledger.schemas import CANONICAL_COLUMNS
from tideledger.sources import inout_series, registry, statements, tabular, transfers
from tideledger.sources.registry import normalize
from tideledger.sources.tabular import SourceError


def test_two_sided_ledger(spark, data):
    result = normalize(spark, "balance_ledger", [data("two_sided.csv")])
    assert result.canonical.columns == CANONICAL_COLUMNS
    assert short(result.canonical) == [
        ("C001", "2023-01", "PAYMENT", 100.0, 0.0, 1, 0, None, None),
        ("C001", "2023-01", "TRANSFER", 250.0, 0.0, 1, 0, None, None),
        ("C001", "2023-02", "CASH_IN", 0.0, 80.0, 0, 1, None, None),
        ("C002", "2023-01", "TRANSFER", 0.0, 250.0, 0, 1, None, None),
        ("C003", "2023-02", "CASH_IN", 80.0, 0.0, 1, 0, None, None),
    ]
    assert rows(result.liquidity) == [
        ("C001", "2023-01", 1000.0, 650.0, 650.0, 1000.0, 2, 0),
        ("C001", "2023-02", 650.0, 730.0, 650.0, 730.0, 1, 0),
        ("C002", "2023-01", 100.0, 350.0, 100.0, 350.0, 1, 0),
        ("C003", "2023-02", 500.0, 420.0, 420.0, 500.0, 1, 0),
    ]


def test_two_sided_fallback(spark, data):
    result = normalize(spark, "balance_ledger", [data("two_sided_odd.csv")])
    flag = "balance_delta_fallback"
    assert short(result.canonical) == [
        ("C1", "2023-01", "CASH_IN", 0.0, 20.0, 0, 1, None, flag),
        ("C1", "2023-01", "PAYMENT", 10.0, 0.0, 1, 0, None, flag),
        ("C1", "2023-01", "REFUND", 0.0, 0.0, 0, 0, None, flag),
        ("C1", "2023-01", "TRANSFER", 20.0, 0.0, 1, 0, None, None),
        ("C2", "2023-01", "CASH_IN", 20.0, 0.0, 1, 0, None, flag),
        ("C2", "2023-01", "TRANSFER", 0.0, 20.0, 0, 1, None, None),
    ]
    breach = {row["client_id"]: row["balance_breach_proxy"] for row in result.liquidity.collect()}
    assert breach == {"C1": 1, "C2": 0}
    merchants = normalize(
        spark, "balance_ledger", [data("two_sided_odd.csv")], {"include_merchants": True}
    ).canonical
    assert "M9" in {row["client_id"] for row in merchants.collect()}


def test_card_ledger(spark, data):
    assert short(normalize(spark, "card_ledger", [data("cards.csv")]).canonical) == [
        ("C001", "2023-01", "es_food", 25.5, 0.0, 1, 0, None, "debit_only"),
        ("C001", "2023-02", "es_transportation", 40.0, 0.0, 1, 0, None, "debit_only"),
        ("C002", "2023-02", "es_food", 12.0, 0.0, 1, 0, None, "debit_only"),
    ]


def test_two_currencies_and_repeated_header(spark, data):
    expected = [
        ("001:A1", "2023-01", "Wire", 100.0, 0.0, 1, 0, "USD", None),
        ("001:A1", "2023-02", "ACH", 100.0, 0.0, 1, 0, "USD", None),
        ("002:B1", "2023-01", "Wire", 0.0, 100.0, 0, 1, "USD", None),
        ("003:C1", "2023-02", "ACH", 0.0, 90.0, 0, 1, "EUR", None),
    ]
    paths = [data("cards.csv"), data("transfers.csv")]
    result = normalize(spark, "currency_transfers", paths)
    assert short(result.canonical) == expected
    assert result.mapping["selected_file"].endswith("transfers.csv")
    with pytest.raises(ValueError, match="exchange rates"):
        normalize(spark, "currency_transfers", paths, {"combine_currencies": True})
    with pytest.raises(SourceError):
        normalize(spark, "currency_transfers", paths, {"selected_file": "other.csv"})


def test_nested_statement(spark, data):
    result = normalize(spark, "nested_statements", [data("statements/plain.json")])
    client = ("IND-001", "2023-01")
    assert short(result.canonical) == [
        (*client, "CASH", 2000.0, 0.0, 1, 0, "INR", None),
        (*client, "CHARGE", 0.0, 0.0, 0, 0, "INR", "failed_excluded"),
        (*client, "NEFT", 0.0, 1000.0, 0, 1, "INR", None),
        (*client, "UPI", 500.0, 0.0, 1, 0, "INR", None),
    ]
    assert rows(result.liquidity) == [(*client, 10000.0, 8900.0, 8500.0, 10500.0, 6, 0)]
    assert rows(statements.failed_operations(statements.read(spark, data("statements/plain.json")))) == [(*client, 1)]


def test_statement_shapes(spark, data):
    paths = [data("statements/wrapped.json"), data("statements/lines.jsonl")]
    found = rows(normalize(spark, "nested_statements", paths).canonical, "client_id", "month", "transaction_label", "debit_sum", "credit_sum")
    assert found == [
        ("J1", "2023-04", "IMPS", 1.0, 0.0),
        ("J2", "2023-04", "CHARGE", 2.0, 0.0),
        ("UNKNOWN_ACCOUNT", "2023-03", "CHEQUE", 0.0, 15.0),
        ("W1", "2023-03", "RTGS", 5.0, 0.0),
    ]


def test_company_ledger(spark, data):
    names = ("companies", "bank_accounts", "bank_transactions", "bank_statements")
    result = normalize(spark, "company_ledger", [data(f"companies/{name}.csv") for name in names])
    assert short(result.canonical) == [
        ("CO1", "2023-01", "Customer receipt", 0.0, 1200.0, 0, 1, None, "one_company"),
        ("CO1", "2023-01", "Rent", 400.0, 0.0, 1, 0, None, "one_company"),
        ("CO1", "2023-02", "Supplies", 250.0, 0.0, 1, 0, None, "one_company"),
    ]
    assert rows(result.liquidity) == [
        ("CO1", "2023-01", 1000.0, 1800.0, 1000.0, 1800.0, 2, 0),
        ("CO1", "2023-02", 1550.0, 1550.0, 1550.0, 1550.0, 1, 0),
    ]


def test_company_directions_and_unknown_account(spark):
    from tideledger.sources import companies

    moves = spark.createDataFrame(
        [("2023-01-01", "A", 5.0, "outgoing"), ("2023-01-01", "A", -7.0, "?"), ("2023-01-01", "B", 0.0, None)],
        "date string, account_id string, amount double, type string",
    )
    accounts = spark.createDataFrame([("A", "X")], "id string, company_id string")
    found = rows(
        companies.to_canonical({"transactions": moves, "accounts": accounts}, "d", "p"),
        "client_id", "transaction_label", "debit_sum", "credit_sum", "debit_nonzero_count", "credit_nonzero_count",
    )
    # "outgoing" holds "out" and "in"; a zero amount still counts.
    assert found == [("UNKNOWN_COMPANY", "OTHER", 0.0, 0.0, 0, 1), ("X", "OTHER", 12.0, 5.0, 2, 1)]
    single = companies.to_canonical({"transactions": moves.drop("account_id")}, "d", "p")
    assert {row["client_id"] for row in single.collect()} == {"SINGLE_COMPANY"}


def test_inout_series(spark, data):
    result = normalize(spark, "inout_series", [data("inout.csv")])
    totals = result.series.selectExpr("sum(inflow)", "sum(outflow)", "sum(net_flow)", "count(*)").first()
    assert tuple(totals) == (9500.0, 7350.0, 2150.0, 8)
    assert result.canonical.count() == 16
    assert {row[0] for row in result.canonical.select("data_quality_flags").collect()} == {"aggregate_series|not_client_level"}


def test_net_only_series_with_repeated_and_bad_dates(spark):
    net = spark.createDataFrame(
        [("2023-01-01", "5"), ("2023-01-01", "-3"), ("never", "9"), ("2023-01-02", "bad")], "Month string, `Net cash flow` string"
    )
    found = [tuple(row)[2:] for row in inout_series.to_series(net).orderBy("date").collect()]
    assert found == [(5.0, 3.0, 2.0), (0.0, 0.0, 0.0)]


def test_category_text(spark, data):
    table = normalize(spark, "category_text", [data("categories.csv")]).categories
    assert table.count() == 7 and table.columns == ["transaction_description", "category", "country", "currency"]


def test_unknown_adapter_names_the_known_ones(spark):
    with pytest.raises(SourceError, match="balance_ledger"):
        normalize(spark, "nothing", [])
    with pytest.raises(SourceError):
        normalize(spark, "balance_ledger", [])


def test_tabular_kinds(spark, data, tmp_path):
    assert rows(tabular.read_tabular(spark, data("document_array.json")), "a", "b") == [(1, "x"), (2, "y")]
    (tmp_path / "one.json").write_text('{"a": 3,\n "b": "z"}')
    assert rows(tabular.read_tabular(spark, str(tmp_path / "one.json")), "a", "b") == [(3, "z")]
    (tmp_path / "two.jsonl").write_text('{"a": 4}\n{"a": 5}\n')
    assert rows(tabular.read_tabular(spark, str(tmp_path / "two.jsonl"))) == [(4,), (5,)]
    with pytest.raises(SourceError):
        tabular.read_tabular(spark, "table.xlsx")
    assert tabular.columns_of(spark, str(tmp_path / "missing.csv")) == []
    # Ids keep their zeros without a schema.
    assert transfers.read(spark, data("transfers.csv")).first()["From Bank"] == "001"


def test_smallest_file_and_selection(spark, data):
    paths = [data("two_sided.csv"), data("cards.csv")]
    smallest = min(paths, key=lambda p: len(open(p).read()))
    assert tabular.choose_file(spark, paths).endswith(smallest.rsplit("/", 1)[1])
    assert tabular.choose_file(spark, paths, "cards.csv").endswith("cards.csv")


def test_number_text(spark):
    texts = ["1,250.50", "-", "", None, "INR 5", "1-2", "-3", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(S.parse_number("t")).collect()] == [1250.5, 0.0, 0.0, 0.0, 5.0, 0.0, -3.0, 0.0]
    plain = ["7", "-7", "1e2", "nan", "5d", " 4 ", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(S.amount("t")).collect()] == [7.0, 7.0, 100.0, 0.0, 0.0, 4.0, 0.0, 0.0]


def test_description_categories(spark):
    cases = {
        "atm cash": "CASH", "UPI/123": "UPI", "upi_x": "OTHER", "chq 4": "CHEQUE", "paycheques": "CHEQUE", "coffee": "CHARGE",
        "coffée": "OTHER", "cashé": "OTHER", "reversed": "REVERSAL", "": "OTHER", "atm\ncash": "CASH",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, expected string")
    assert S.with_category(df, "text").where("category <> expected").collect() == []


def test_source_capabilities():
    assert registry.SOURCES["card_ledger"].limitations == {"debit_only", "no_balance", "no_credit_flow"}


def test_dates_in_many_forms(spark):
    from tideledger.functions.dates import parse_moment

    both = {
        "2022-09-01": "2022-09-01 00:00:00", "2022-09-01T10:30:00": "2022-09-01 10:30:00", "2022/09/01 00:20": "2022-09-01 00:20:00",
        "2022/9/1": "2022-09-01 00:00:00", "2022/09/01 00:20:11.5": "2022-09-01 00:20:11.500000", "20250105": "2025-01-05 00:00:00",
        "20250105 7:08": "2025-01-05 07:08:00", "20250105T070809": "2025-01-05 07:08:09", "1.2.2024": "2024-02-01 00:00:00",
        "3 Mar 2024": "2024-03-03 00:00:00", "3-MAR-2024": "2024-03-03 00:00:00", "Mar 3, 2024": "2024-03-03 00:00:00", "Jan 5 2025": "2025-01-05 00:00:00",
        "5 January 2025 11:59 pm": "2025-01-05 23:59:00", "Sept. 5, 2025": "2025-09-05 00:00:00", "2025-01": "2025-01-01 00:00:00",
        " 2024-02-30 ": None, "soon": None, "": None, None: None, "45000": None, "2025": None, "3 Mai 2024": None, "1/2/3/2024": None, "31.02.2024": None,
    }
    one = {"05/01/2025": ("2025-05-01 00:00:00", "2025-01-05 00:00:00"), "05/01/25": ("2025-05-01 00:00:00", "2025-01-05 00:00:00")}
    one |= {"1/5/2025 3:04 PM": ("2025-01-05 15:04:00", "2025-05-01 15:04:00"), "1/5/2025 12:04 AM": ("2025-01-05 00:04:00", "2025-05-01 00:04:00")}
    one |= {"25-12-2024 8:05": (None, "2024-12-25 08:05:00"), "12/25/1999": ("1999-12-25 00:00:00", None), "1/2/69": ("1969-01-02 00:00:00", "1969-02-01 00:00:00")}
    texts = [*both, *one]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for side, day_first in enumerate((False, True)):
        got = [str(r[0]) if r[0] else None for r in df.select(parse_moment("t", day_first)).collect()]
        assert dict(zip(texts, got)) == both | {t: want[side] for t, want in one.items()}


def test_a_source_has_one_order_of_dates(spark, tmp_path):
    from tideledger.functions import dates

    def column(*texts):
        return spark.createDataFrame([(t,) for t in texts], "t string")

    assert dates.day_first_of(column("05/01/2025", "25/01/2025 7:00", "2025-13-01", None), "t")
    assert not dates.day_first_of(column("05/01/2025", "01/25/2025"), "t") and not dates.day_first_of(column("05/01/2025"), "t")
    with pytest.raises(dates.DateOrderError):
        dates.day_first_of(column("25/01/2025", "01/25/2025"), "t")
    (tmp_path / "transactions.csv").write_text("date,amount,company_id\n25/01/2025,-1,k\n05/01/2025,-2,k\n")
    moved = normalize(spark, "company_ledger", [str(tmp_path / "transactions.csv")]).canonical
    assert [(r.month, r.debit_sum) for r in moved.collect()] == [("2025-01", 3.0)]
    chosen = normalize(spark, "company_ledger", [str(tmp_path / "transactions.csv")], {"day_first": False}).canonical
    assert [(r.month, r.debit_sum) for r in chosen.collect()] == [("2025-05", 2.0)]


def test_balances_are_exact_at_any_size(spark):
    """Ties of moment and place, balances of many digits and places beyond ten million."""
    from tideledger.operators import canonical as can

    day = F.lit("2024-01-05").cast("timestamp")
    rows = [("c", 0, 20_000_000, 7e12), ("c", 0, 20_000_001, 7e12 + 0.001), ("c", 0, 20_000_001, 7e12 + 0.002), ("c", 2, 0, -9e11), ("c", 0, 19_999_999, 3.0), ("c", 0, 19_999_999, 2.999)]
    df = spark.createDataFrame(rows, "client_id string, kind int, place int, balance double").withColumns({"month": F.lit("2024-01"), "order": can.packed_order(day, F.col("kind"), F.col("place"))})
    found = can.monthly_balances(df, ["order"])
    assert rows_of(found) == [("c", "2024-01", 2.999, -9e11, -9e11, 7e12 + 0.002, 6, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    spread = df.repartition(5).withColumn("account", F.col("place") % 3)
    merged = can.merged_ends(can.observed_ends(spread, ["account", "client_id", "month"], "order"), ["client_id", "month"])
    assert rows_of(can.balances_of(merged)) == rows_of(found)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_transfers_in_another_column_order_and_in_two_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
        "2022/09/01 00:20,010,A1,020,B1,5.5,USD,5.5,USD,Wire,0\n"
    )
    (tmp_path / "two.csv").write_text(
        "Is Laundering,Payment Format,Payment Currency,Amount Paid,Receiving Currency,Amount Received,Account,To Bank,Account,From Bank,Timestamp,Note\n"
        "0,ACH,USD,7,USD,7,A2,020,B2,010,09/30/2022,x\n"
    )
    paths = [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]
    found = {(r.client_id, r.month, r.debit_sum, r.credit_sum) for r in normalize(spark, "currency_transfers", paths).canonical.collect()}
    assert found == {("010:A1", "2022-09", 5.5, 0.0), ("020:B1", "2022-09", 0.0, 5.5), ("010:A2", "2022-09", 7.0, 0.0), ("020:B2", "2022-09", 0.0, 7.0)}
    one = normalize(spark, "currency_transfers", paths, {"selected_file": "two.csv"})
    assert one.canonical.count() == 2 and one.mapping["selected_file"] == paths[1]
    (tmp_path / "bad.csv").write_text("Timestamp,From Bank,Account\n1,2,3\n")
    with pytest.raises(tabular.SourceError):
        tabular.read_by_header(spark, str(tmp_path / "bad.csv"), ["Timestamp", "Account", "Account.1"])


def test_failed_as_banks_write_it(spark, tmp_path):
    moves = ",".join(
        f'{{"date": "05/01/2025", "debit": "10", "description": "x", "failed": {value}}}' for value in ("true", "1", '"true"', "1.5", "false", "0", '""', "null", "0.0")
    )
    (tmp_path / "s.json").write_text(f'{{"customer_id": "c", "transactions": [{moves}]}}')
    payloads = statements.statements(statements.read(spark, str(tmp_path / "s.json")))
    assert [(r.failed, r.debit) for r in statements.transactions(payloads).orderBy("place").collect()] == [(True, 0.0)] * 4 + [(False, 10.0)] * 5
    assert {r.month for r in statements.to_canonical(payloads, "d", "p").collect()} == {"2025-05"}
    assert {r.month for r in statements.to_canonical(payloads, "d", "p", day_first=True).collect()} == {"2025-01"}


def test_tables_and_series_spread_over_files(spark, tmp_path):
    for n, day in enumerate(("2024-01-05", "01/20/2024")):
        folder = tmp_path / f"part{n}"
        folder.mkdir()
        (folder / "transactions.csv").write_text(f"date,amount,company_id\n{day},-{n + 1},k\n")
        (folder / "flow.csv").write_text(f"date,inflow,outflow\n{day},{n + 1},0\n2024-02-01,10,1\n")
    paths = [str(tmp_path / f"part{n}" / name) for n in range(2) for name in ("transactions.csv", "flow.csv")]
    moved = normalize(spark, "company_ledger", [p for p in paths if "transactions" in p]).canonical.collect()
    assert [(r.client_id, r.month, r.debit_sum) for r in moved] == [("k", "2024-01", 3.0)]
    series = normalize(spark, "inout_series", [p for p in paths if "flow" in p]).series
    assert sorted((str(r.date)[:10], r.inflow, r.net_flow) for r in series.collect()) == [("2024-01-05", 1.0, 1.0), ("2024-01-20", 2.0, 2.0), ("2024-02-01", 20.0, 18.0)]


def test_rows_without_a_date_are_counted(spark):
    from tideledger.functions.scalars import parse_moment

    df = spark.createDataFrame([("2024-01-01",), ("never",), (None,)], "t string")
    assert tuple(tabular.unreadable_dates(df, parse_moment("t")).first()) == (3, 2)
