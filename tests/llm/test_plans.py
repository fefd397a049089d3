"""What the plans of the native operators are made of, and where shared files go."""

import re

import pytest

from tessera.llm import chat_format, common, queries


@pytest.mark.parametrize("name", ["op6_license_scan", "op10_chat_format"])
def test_native_plans_run_no_python(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|MapIn|CartesianProduct", plan)


def test_linked_chats_run_no_python(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"x"}}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"r"}')]
    df = chat_format.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat_format.tool_table(spark))
    assert not re.search("PythonUDF|Pandas|InArrow|EvalPython|CartesianProduct", df._jdf.queryExecution().executedPlan().toString())
    assert [(r.turn, r.n_calls, r.n_answered, r.n_invalid, r.answers_turn) for r in df.orderBy("turn").collect()] == [(0, 1, 1, 0, None), (1, 0, 0, 0, 0)]


def test_chat_cases(spark):
    call = lambda i, name, args: f'{{"tool_calls":[{{"id":"{i}","name":"{name}","arguments":{args}}}]}}'
    rows = [
        (1, 0, "tool", '{"tool_call_id":"z"}'), (1, 1, "assistant", call("z", "python", '{"code":"1"}')),  # the result came first
        (2, 0, "assistant", call("a", "search", '{"query":"x","limit":"many"}')), (2, 1, "tool", '{"tool_call_id":"a"}'),  # a wrong type
        (2, 2, "assistant", call("b", "weather", '{"city":"$ref:a"}')), (2, 3, "tool", '{"tool_call_id":"b"}'), (2, 3, "tool", '{"tool_call_id":"b"}'),
        (3, 0, "assistant", call("m", "python", '{"code":"$ref:m"}')), (3, 1, "tool", '{"tool_call_id":"m"}'),  # a cycle
        (4, 0, "user", None), (4, 1, "user", "{broken"), (4, 2, "tool", '{"a":1}'), (None, None, None, None), (5, 0, "assistant", call("q", "nope", "{}")), (5, 1, "assistant", call("r", "search", "{}")),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_calls long")
    out = chat_format.format_messages(df, chat_format.tool_table(spark)).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert (by[1, 0].order_turn, by[1, 0].order_depth, by[1, 1].order_turn, by[1, 1].order_depth) == (1, 1, 1, 0)
    assert by[2, 0].n_invalid == 1 and by[2, 2].n_invalid == 0 and by[2, 3].answers_turn == 2
    assert by[3, 0].in_cycle and by[3, 1].in_cycle and not by[2, 0].in_cycle
    assert by[5, 0].n_invalid == 1 and by[5, 1].n_invalid == 1 and by[5, 0].n_answered == 0
    assert by[4, 0].message == '{"content":null,"role":"user"}'
    assert by[2, 0].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":"many","query":"x"},"id":"a","name":"search"}]}'
    assert chat_format.format_messages(df.where("false"), chat_format.tool_table(spark)).count() == 0


def test_calls_keep_content_and_fields(spark):
    text = '{"zeta":[1,{"b":1,"a":2}],"content":"say \\"x\\"","role":"other","Alpha":null,"tool_calls":[{"id":"a","name":"search","arguments":{"query":"x"}}]}'
    rows = [(1, 0, "assistant", text), (1, 0, "user", "of the same turn"), (1, 1, "user", "later")]
    out = chat_format.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat_format.tool_table(spark)).collect()
    by = {(r.turn, r.role): r for r in out}
    assert len(out) == 3 and by[0, "assistant"].n_calls == 1 and by[0, "user"].n_calls == 0
    assert by[0, "assistant"].message == '{"Alpha":null,"content":"say \\"x\\"","role":"assistant","tool_calls":[{"arguments":{"query":"x"},"id":"a","name":"search"}],"zeta":[1,{"a":2,"b":1}]}'


def test_chat_sql(spark, sf_dir):
    from oracle import connect, rows

    mine = queries.op10_chat_format(spark, sf_dir).toPandas()
    assert rows(mine) == rows(connect(sf_dir).execute(queries.ORACLES["op10_chat_format"]).df())


def test_shared_folder_is_the_session_s_own(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = common.cut(spark.range(10))
    assert df.count() == 10 and all(f.startswith(common.shared_dir(spark).replace("file://", "file:///").replace("file:////", "file:///")) for f in df.inputFiles())
