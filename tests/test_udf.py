from leafloom.functions.udf import register


def test_functions_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "<title> a  b</title><p>x <b>y</b><a href=u>l</a>", "https://h/"), (2, None, None)], "page_id long, html string, url string").createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT page_id, page_title(html) AS t, page_text(html) AS x, page_markdown(html) AS m FROM sql_pages ORDER BY page_id").collect()
    assert tuple(got[0]) == (1, "a b", "a b\nx yl", "x **y**[l](u)")
    assert tuple(got[1]) == (2, None, None, None)
    links = spark.sql("SELECT page_id, l.text, l.href, l.url FROM sql_pages, LATERAL page_links(html, url) AS l").collect()
    assert [tuple(r) for r in links] == [(1, "l", "u", "https://h/u")]
    assert [r["name"] for r in spark.sql("SELECT e.name FROM sql_pages, LATERAL page_elements(html, 'p > *') AS e ORDER BY e.id").collect()] == ["b", "a"]
    assert spark.sql("SELECT m.value FROM LATERAL page_microdata('<p itemscope><b itemprop=n>v</b></p>', NULL) AS m").first()[0] == "v"
