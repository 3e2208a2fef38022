from quarry.sources.metadata import table_ddl, where_clause


def test_ddl():
    ddl = table_ddl("t", {"a": {"type": "text"}, "n": {"type": "nested", "properties": {"x": {"type": "long"}}}})
    assert ddl == "CREATE TABLE `t` (`_id` STRING, `a` STRING, `n` ARRAY<STRUCT<`x`: BIGINT>>) USING parquet"


def test_where():
    body = {"bool": {"must": [{"match": {"t": "x"}}, {"range": {"n": {"gte": 1, "lt": 5}}}], "must_not": {"term": {"s": "no"}}}}
    assert where_clause(body) == ("(`t` LIKE ? AND `n` >= ? AND `n` < ?) AND NOT (`s` = ?)", ["%x%", 1, 5, "no"])
    assert where_clause({"match_all": {}}) == ("TRUE", [])
