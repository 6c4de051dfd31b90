"""What a task gets does not grow with the input."""

import os

import pytest

from leafloom.limits import Limits
from leafloom.plans import catalog


def test_pages_of_orders_are_bounded(spark, sf, duck, same, monkeypatch):
    monkeypatch.setattr(catalog, "ORDERS_A_PAGE", 64, raising=False)
    monkeypatch.setattr(catalog, "Limits", lambda **_: Limits(max_nodes=64 * 2 + 8))  # pages beyond it have no rows
    got = catalog.queries()["descendant_of_large_pages"](spark, sf).toPandas()
    assert same(got) == same(duck.execute(catalog.oracle_sql()["descendant_of_large_pages"]).df())


def test_sets_of_nodes_meet_in_one_exchange(spark, sf):
    out = catalog.queries()["sets_of_nodes_by_join"](spark, sf)
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert "Aggregate" in top and "Join" not in top


def test_markup_from_scans_and_stored_pages_is_dealt_by_rows(spark, monkeypatch):
    from leafloom.sources import pages, stored

    monkeypatch.setattr(pages.tasks_for, "__defaults__", (100,))
    docs = catalog.rows_of(spark.range(3000).coalesce(1).selectExpr("id AS page_id", "'<p>x' AS html"))
    assert docs.df.rdd.getNumPartitions() == 30 and max(docs.df.rdd.glom().map(len).collect()) < 200
    kept = stored.store_nodes(docs, "id", "name")
    assert kept.df.count() == 3000 * 6 and len(kept.df.inputFiles()) == 30
    kept.drop()


def test_gathered_pages_get_more_tasks_where_there_are_more_pieces(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PIECES_A_TASK", 100, raising=False)
    rows = spark.range(3000).selectExpr("id div 3 AS k", "id AS o", "cast(id AS string) AS p")
    got = catalog.gathered(rows, "k", "o", rows["p"], "<", ">")
    assert got.rdd.getNumPartitions() == 30 and got.where("page_id = 7").first()["html"] == "<212223>"


@pytest.mark.parametrize("name", ["capped_files", "title_of_files"])
def test_files_have_a_folder_a_task(spark, sf, duck, same, monkeypatch, name):
    monkeypatch.setattr(catalog, "FILES_A_TASK", 25)
    shared = catalog.shared_dir(spark)
    before = set(os.listdir(shared))
    out = catalog.queries()[name](spark, sf)
    (folder,) = (x for x in set(os.listdir(shared)) - before if x.startswith("files-"))
    rows = duck.execute(f"SELECT count(*) FROM {'supplier' if name == 'capped_files' else 'pages'}").fetchone()[0]
    tasks = max(4, -(-rows // 25))
    held = [len(names) for at, _, names in os.walk(os.path.join(shared, folder)) if at.count("/") > shared.count("/") + 1]
    assert len(held) == tasks and sum(n for n in held) >= rows and out.rdd.getNumPartitions() <= 2 * tasks
    assert same(out.toPandas()) == same(duck.execute(catalog.oracle_sql()[name]).df())
