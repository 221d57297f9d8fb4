"""Chat formatting: round trips, layouts by their fingerprints, odd tables, and the query against SQL."""

import hashlib
import json

import duckdb
import pytest

from maskloom.llm import chat
from maskloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
HARD = ["</s>", "<\\/s>", "<\\\\|end|>", "<|turn|>user<|text|>x<|end|>", "[INST] a [/INST]", "<<s>>", "\\", "", "a\nb", "é𝒳</s>é", "<|im_start", "|end|><|", "<" * 5 + "|text|>" * 2, "$1\\$2"]


def turns(*said):
    return [(r, t) for r, t in said]


def rows(spark, data):
    return spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in d]) for i, d in enumerate(data)], "k int, turns array<struct<role:string,text:string>>")


def test_any_text_comes_back_and_no_control_string_stays(spark):
    data = [turns(("user", a), (b, a), ("assistant", b), ("assistant", a + b)) for a in HARD for b in HARD] + [[]]
    out = chat.format_turns(rows(spark, data)).cache()
    t = chat.Template()
    for r in out.collect():
        marks = r["formatted"].count(t.start), r["formatted"].count(t.middle), r["formatted"].count(t.end)
        assert marks == (len(data[r["k"]]),) * 3 and not any(c in r["formatted"] for c in t.controls)
        assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == [p.split(t.middle)[1] for p in r["formatted"].split(t.end) if p.startswith(t.start + "assistant" + t.middle)]
    for r in chat.read_back(out.select("k", "formatted", "loss_spans")).collect():
        want = data[r["k"]]
        assert [tuple(x) for x in r["turns"]] == want and r["learnt"] == [x for role, x in want if role == "assistant"]


RECORDS = {
    "messages": ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "id": 3}, [("system", "s"), ("user", "ab")]),
    "from_value": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, {"from": "tool", "value": "t"}]}, [("user", "q"), ("assistant", ""), ("tool", "t")]),
    "prompt_messages": ({"prompt": [{"role": "user", "content": "x"}], "completion": [{"role": "assistant", "content": "y"}]}, [("user", "x"), ("assistant", "y")]),
    "instruction": ({"instruction": "do", "input": "", "output": "{\"a\": [1]}", "history": [["p", "q"], ["r"]]}, [("user", "p"), ("assistant", "q"), ("user", "r"), ("user", "do"), ("assistant", "{\"a\": [1]}")]),
    "prompt_completion": ({"prompt": "p", "completion": "c", "system": "s", "meta": {"deep": [{"x": 1}]}}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    "prompt_response": ({"prompt": "p", "response": 3}, [("user", "p"), ("assistant", "3")]),
    "question_answer": ({"question": "q", "answer": "a", "context": "c"}, [("user", "c\nq"), ("assistant", "a")]),
    "turn_rows": ({"conv_id": 1, "turn": 0, "role": "user", "text": None}, [("user", "")]),
}


def test_layouts_of_json_records_and_of_variants(spark):
    texts = [json.dumps(r) for r, _ in RECORDS.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    for given in (df, df.selectExpr("k", "parse_json(j) as j")):
        for r, (name, (record, want)) in zip(chat.canonical(given, "j").orderBy("k").collect(), RECORDS.items()):
            assert r["layout"] == name and [tuple(x) for x in r["turns"]] == want and len(r["fingerprint"]) == 32


def test_unknown_and_broken_records_have_no_layout(spark):
    texts = ["no json", None, "", "[1]", "3", "{}", '{"messages": []}', '{"messages": "x"}', '{"prompt": "p"}', '{"instruction": {"a": 1}, "output": "x"}']
    out = chat.canonical(spark.createDataFrame(list(enumerate(texts)), "k int, j string"), "j")
    assert all(r["layout"] is None and r["fingerprint"] is None and r["turns"] == [] for r in out.collect())


def test_typed_tables_have_the_paths_of_their_schema(spark):
    one = spark.createDataFrame([(1, [("user", "hi")], 2), (2, None, 3)], "id long, messages array<struct<role:string,content:string>>, layout int")
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical(one).orderBy("id").collect()] == [("messages", [("user", "hi")]), ("messages", [])]
    assert set(chat.schema_paths(one.schema)) == {"id", "layout", "messages[]", "messages[].role", "messages[].content"}
    other = spark.createDataFrame([("a", "b", "c")], "prompt string, completion string, `x.y` string")
    assert [tuple(t) for t in chat.canonical(other).first()["turns"]] == [("user", "a"), ("assistant", "b")]


def test_a_records_paths_and_fingerprint_agree_with_python(spark):
    def walk(v, at):
        if isinstance(v, dict):
            return {p for k, x in v.items() for p in walk(x, f"{at}.{k}" if at else k)} if v or at == "" else set()
        if isinstance(v, list):
            return {f"{at}[]"}.union(*(walk(x, f"{at}[]") for x in v))
        return {at}

    from pyspark.sql import functions as F

    texts = [json.dumps(r) for r, _ in RECORDS.values()]
    df = spark.createDataFrame([(t,) for t in texts], "j string").select("j", F.parse_json("j").alias("v"))
    for r in df.select("j", F.array_sort(F.array_distinct(chat.record_paths(F.col("v")))).alias("p")).collect():
        assert r["p"] == sorted(walk(json.loads(r["j"]), ""))


def digested(spark, data):
    return {r["conv_id"]: r for r in chat.digest(spark.createDataFrame(data, "conv_id long, turn int, role string, text string, turns int")).collect()}


def test_nulls_ties_repeats_and_an_empty_table(spark):
    data = [(1, None, "user", None, 0), (1, 0, None, "x", 0), (1, 0, "assistant", "a", 0), (1, 0, "assistant", "a", 0), (None, 3, "assistant", "é𝒳", 0), (2, 1, "user", "z" * 300_000, 0)]
    got = digested(spark, data)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha("user\n\n\nx\nassistant\na\nassistant\na\n") and got[1]["loss_sha256"] == sha("aa")
    assert got[None]["loss_chars"] == 2 and got[2]["formatted_chars"] == 300_000 + len("<|turn|>user<|text|><|end|>") and got[2]["loss_sha256"] == sha("")
    assert got[-7]["loss_sha256"] == sha(chat.HOSTILE) and got[-7]["n_turns"] == 2
    assert set(digested(spark, [])) == {-7}


@pytest.mark.parametrize("name,table", [("op11_chat_format", "conversations"), ("op12_hard_negatives", "embeddings"), ("op13_spelling_variants", "documents")])
def test_the_queries_equal_their_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())


def test_no_python_worker_runs(spark):
    plan = QUERIES["op11_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
