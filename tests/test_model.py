import pytest
from pyspark.sql import functions as F

from plumbline.functions import measures as ms
from plumbline.operators.columns import resolve
from plumbline.plans import measures as pm
from plumbline.plans.model import Model, discover, is_key_candidate, name_match, unify


@pytest.fixture
def shop(spark):
    orders = spark.createDataFrame(
        [(1, "1.0", 10.0, 2.0), (2, "2", 20.0, 5.0), (3, None, 30.0, 1.0), (4, "9", 40.0, 4.0), (5, " 1 ", 50.0, 6.0)],
        "order_id int, customer_id string, sales double, profit double",
    )
    customers = spark.createDataFrame(
        [(1, "Germany", "West", 7.0), (1, "Austria", "West", 8.0), (2, "Japan", "East", 9.0), (None, "Nowhere", "None", 0.0)],
        "customer_id int, country string, region string, sales double",
    )
    model = Model().add("Orders", orders).add("Customers", customers)
    assert model.relate("Orders", "customer_id", "Customers", "customer_id")
    return model


def test_unify_keeps_rows_and_keys_match_as_text(shop):
    rows = {r["order_id"]: r for r in unify(shop, "Orders").collect()}
    assert len(rows) == 5
    assert rows[1]["country"] == "Austria" and rows[5]["country"] == "Austria"  # the smallest of two rows per key
    assert rows[3]["country"] is None and rows[4]["country"] is None  # null and unmatched keys
    assert rows[2]["Customers_sales"] == 9.0 and rows[2]["sales"] == 20.0


def test_unify_backwards_keeps_one_child(shop):
    rows = unify(shop, "Customers").collect()
    assert len(rows) == 4
    assert {r["order_id"] for r in rows if r["customer_id"] == 1} == {1}


def test_many_rows_of_one_key(spark):
    facts = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("item_id"), "id")
    items = spark.range(500).select(F.lit(1).alias("item_id"), F.col("id").alias("label"))
    model = Model().add("facts", facts).add("items", items)
    model.relate("facts", "item_id", "items", "item_id")
    joined = unify(model, "facts")
    assert joined.count() == 3000 and joined.agg(F.max("label")).first()[0] == 0


def test_summarize(shop):
    measures = {
        "revenue": ms.total(F.col("sales")), "margin": ms.divide(F.sum("profit"), F.sum("sales")),
        "german": ms.calculate(ms.total, F.col("sales"), F.lower("country") == "germany"), "rows": ms.row_count(),
    }
    got = [tuple(r) for r in pm.summarize(shop, "Orders", ["region"], measures).collect()]
    assert got == [("West", 60.0, 0.13, 0.0, 2), ("East", 20.0, 0.25, 0.0, 1)]


def test_auto_measures(shop):
    got = {r["id"]: r for r in pm.auto_measures(shop, "Orders").collect()}
    assert got["sum_sales"]["value"] == 150.0 and got["sum_sales"]["formatted"] == "$150.00"
    assert got["profit_margin"]["formatted"] == "12.00%" and got["count_records"]["formatted"] == "5 Records"


def test_discovery(spark):
    orders = spark.createDataFrame([(i, i % 4, i % 2) for i in range(20)], "order_no int, customer_id int, status int")
    customers = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "id int, name string")
    strangers = spark.createDataFrame([(i + 1000, "x") for i in range(4)], "customer_id int, name string")
    model = Model().add("orders", orders).add("customers", customers).add("strangers", strangers)
    edges = [tuple(r) for r in discover(model).collect()]
    assert edges == [("orders", "customer_id", "customers", "id", "many_to_one", 1.0, 1)]
    assert discover(model).count() == 0  # found once
    assert model.fact_table() == "orders"
    model.drop("customers")
    assert model.relationships == []


def test_names():
    assert is_key_candidate("order_id") and is_key_candidate("SKU") and not is_key_candidate("price")
    assert name_match("orders", "Customer_ID", "customers", "customer-id") == 2
    assert name_match("orders", "customer_id", "customers", "id") == 1
    assert name_match("orders", "price_code", "customers", "key") == 0


def test_relate_refuses_unknown(shop):
    assert not shop.relate("Orders", "nothing", "Customers", "customer_id")
    shop.unrelate("Orders", "customer_id", "Customers", "customer_id")
    assert shop.relationships == []


def test_resolver(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Name int, nation_code int, region_code int")
    assert resolve(df, "name") == "Name" and resolve(df, "code", "region") == "region_code"
    with pytest.raises(ValueError, match="ambiguous"):
        resolve(df, "code")
    with pytest.raises(ValueError, match="not found"):
        resolve(df, "price")
