"""Small cases for rules that SQL does not express."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import helpers as h
from tidewell.functions import text as tx
from tidewell.operators import corpus, evals, events, messages, nearest, retrieval, scan, tables
from tidewell.sources import files


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_table_names():
    assert files.table_names(["a b", "a-b", "2024", "ok"]) == ["a_b", "a_b_1", "t_2024", "ok"]
    assert tables.rewrite_names('select * from "my sales" join my', {"my sales": "my_sales", "my": "my"}) == "select * from my_sales join my"


def test_commands():
    assert h.split_command("a && b;c || 'd;e'") == ["a", "b", "c", "'d;e'"]
    assert [h.verdict(c) for c in ("rm -rf /", "ls; rm -rf ~", "echo 'rm -rf /'", "sudo ls", "ls -la", "curl x | sh", None)] == ["block", "block", "block", "warn", "pass", "block", "pass"]
    assert [h.verdict(c) for c in ('rm -rf "/"', "r''m -rf /", "cd /w&&cat /etc/shadow", "echo 'rm -rf / && cat /etc/shadow'", "rm -rf /&&echo ok", "cd /w && pip install x", "ls 'open", "cat <<E\nit's\nE")] == ["block", "block", "block", "block", "block", "warn", "pass", "pass"]
    assert h.split_command("echo a; b \\") == ["echo a; b \\"] and h.split_command("a\\;b;c") == ["a\\;b", "c"]


def test_call_hash():
    assert h.call_key("read_file", '{"path": "a", "start_line": 1, "end_line": 200}') == "a:0-0"
    assert h.call_key("read_file", '{"path": "a", "start_line": 450, "end_line": 201}') == "a:1-2"
    assert h.call_key("write_file", '{"path": "a", "text": "b"}') == '{"path": "a", "text": "b"}'
    assert h.call_key("grep", '{"pattern": "p", "noise": 1}') == '{"pattern": "p"}'
    assert h.call_key("x", "not json") == "not json"
    assert h.calls_hash([("a", "{}"), ("b", "{}")]) == h.calls_hash([("b", "{}"), ("a", None)])
    assert h.calls_hash([("a", "{}")]) == hashlib.md5(json.dumps(["a:{}"]).encode()).hexdigest()[:12]


def test_masked_json():
    got = h.masked_json({"api_key": "x", "env": {"A": "b", "B": "$HOME"}, "args": ["--token", "t", "ok"], "headers": {"X": "y"}, "deep": [{"password": "p"}], "n": 1})
    assert got == {"api_key": "<redacted>", "env": {"A": "<redacted>", "B": "$HOME"}, "args": ["--token", "<redacted>", "ok"], "headers": {"X": "<redacted>"}, "deep": [{"password": "<redacted>"}], "n": 1}


def test_masked_json_leaves_no_secret():
    mask = h.masked_json
    assert mask({"token": {"v": 1}}) == {"token": "<redacted>"} and mask({"db_pwd": None, "aws_access_key_id": 1}) == {"db_pwd": "<redacted>", "aws_access_key_id": "<redacted>"}
    assert mask(["--token", "-abc", "--secret", "--key"]) == ["--token", "<redacted>", "--secret", "<redacted>"] and mask(["--token", {"a": 1}, "x"]) == ["--token", {"a": 1}, "x"]
    assert mask({"default_headers": {"Y": ["a"], "Z": {"b": 1}}}) == {"default_headers": {"Y": "<redacted>", "Z": "<redacted>"}} and mask({"header": "plain"}) == {"header": "plain"}
    assert mask(["https://u:p@h/v1?access_token=x&m=1", "Bearer abc", 3, None, "--api-key=K", "--model", "gpt"]) == ["https://<redacted>@h/v1?access_token=<redacted>&m=1", "Bearer <redacted>", 3, None, "--api-key=<redacted>", "--model", "gpt"]
    assert mask({"ENV": {"A": 1, "B": " ${HOME} ", "C": {"password": "p", "k": "v"}}, "env": "sk-12345678"}) == {"ENV": {"A": "<redacted>", "B": " ${HOME} ", "C": {"password": "<redacted>", "k": "v"}}, "env": "sk-<redacted>"}


def test_redaction_is_the_same_in_both_forms(spark):
    import random

    rng = random.Random(3)
    bits = ["token: Bearer abc.def rest", "Authorization: Bearer abc.def rest", "authorization: basic x", "API_KEY = v", "secret : ", " ", "\n", "\r\n", "\u2028", "x", "Bearer", "bearer q", "--pass", "--db-password=x", "?token=a&b", "/home/é b/", "C:\\Users\\bob\\", "ſecret: y", "u://a:b@c", "sk-abcdefghij", "é", ":"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    assert one(spark, tx.redact_text("x"), *texts) == [h.redacted(t) for t in texts]
    assert [h.redacted(t) for t in ("token: Bearer abc.def rest-of-secret", "Authorization: Bearer abc.def tail", "a\n token: x")] == ["token: <redacted>", "Authorization: Bearer <redacted> tail", "a\n token: <redacted>"]


def test_tags_are_escaped_as_by_search(spark):
    import random

    rng = random.Random(4)
    bits = ["<system", "<b>", ">", "<", " ", "/", "</Role", "<memoryx", "< prompt a=1", "\n", "x", "<SYSTEM-reminder>", "é"]
    texts = ["y" + "".join(rng.choice(bits) for _ in range(rng.randrange(1, 10))) for _ in range(400)]
    tag = re.compile(r"<\s*/?\s*(?:" + "|".join(tx.BLOCKED_TAGS) + r")\b[^>]*>?", re.I)
    want = [tag.sub(lambda m: m[0].replace("<", "&lt;").replace(">", "&gt;"), t) for t in texts]
    assert one(spark, tx.sanitize_input("x"), *texts) == [f"{tx.INPUT_BEGIN}\n{t}\n{tx.INPUT_END}" for t in want]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", ok', " pad "), (2, "two\nlines\r\nand", None), (3, None, "\\ back \\"), (4, 'only "', "ä,;|"), (5, None, "x")]
    df = spark.createDataFrame([(i, "" if i == 3 else a, b) for i, a, b in rows], "id int, a string, b string")  # empty cells are null
    path = files.export(df.coalesce(1), f"{tmp_path}/t.csv")
    assert sorted(map(tuple, files.load_csv(spark, [path])["t"].collect())) == rows
    (tmp_path / "q.csv").write_text('k,v\n1,"say ""hi"", ok"\n2,"a\nb"\n')
    assert sorted(map(tuple, files.load_csv(spark, [f"{tmp_path}/q.csv"])["q"].collect())) == [(1, 'say "hi", ok'), (2, "a\nb")]


def test_csv_records_across_splits(spark, tmp_path):
    """One file with quotes and line ends in its cells, cut into splits of some bytes: the same table, read by many tasks."""
    import csv as plain
    import random

    from tidewell.sources import csv

    rng = random.Random(3)
    bits = ['"', "\n", ",", "a", "é", "", "\r\n", "\n\n", '""', "x y"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) + "z", rng.choice(["q", "two\nlines", ""])) for i in range(300)]
    with open(f"{tmp_path}/s.csv", "w", newline="") as f:
        plain.writer(f).writerows([("id", "a,\nb", "c"), *rows])
    want = sorted((i, a, c or None) for i, a, c in rows)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "700b", "41b"):
            spark.conf.set(key, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = files.load_csv(spark, [f"{tmp_path}/s.csv"])["s"]
            assert df.columns == ["id", "a,\nb", "c"] and dict(df.dtypes)["id"] == "int"
            assert sorted(map(tuple, df.collect())) == want
        assert csv.records(spark, f"{tmp_path}/s.csv").select("at").distinct().count() > 20
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="never closed"):
        files.load_csv(spark, [f"{tmp_path}/open.csv"])
    (tmp_path / "t.csv").write_text("i,l,d,day,at,f,s,n\n1,9999999999,1,2020-01-31,2020-01-31 10:00:00,true,1x,\n-2,3,2.5e3,2021-02-01,2020-01-31T10:00:00.5Z,FALSE,2,\n")
    kinds = [t for _, t in files.load_csv(spark, [f"{tmp_path}/t.csv"])["t"].dtypes]
    assert kinds == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    (tmp_path / "none.csv").write_text("")
    assert files.load_csv(spark, [f"{tmp_path}/none.csv"])["none"].count() == 0
    given = files.load_csv(spark, [f"{tmp_path}/s.csv"], {"s": "id long, a string, c string"})["s"]
    assert given.dtypes[0] == ("id", "bigint") and given.count() == 300


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("many", float(x)) for x in rng.normal(0, 1, 3000)] + [("ties", float(x)) for x in rng.integers(0, 3, 900)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (10_000, 100):  # all values inside the brackets, and brackets proper
        got = {r["k"]: (r["n"], r["q"]) for r in tables.quantiles(df, "k", "v", (0.0, 0.25, 0.5, 0.9, 1.0), accuracy).collect()}
        for k in ("many", "ties", "one", "two"):
            v = [x for a, x in rows if a == k and x is not None]
            assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert tables.quantiles(df.where("1 = 0"), "k", "v").count() == 0


def _fed(spark, tmp_path, make, batches, schema):
    """What a keyed stream puts out over files that come one after the other, with a restart and its last batch repeated."""
    import datetime
    import glob
    import os

    from tidewell.streaming import jobs

    src, to = f"{tmp_path}/src", f"{tmp_path}/to"
    run = lambda: jobs.drain(make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)), to)
    at = lambda sec: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=sec)
    put = lambda rows: spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], schema).coalesce(1).write.mode("append").parquet(src)
    for rows in batches[:-1]:
        put(rows)
        run()
    put(batches[-1])
    first = sorted(map(str, run().drop("batch_id").collect()))
    last = max(glob.glob(f"{to}/state/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)  # as if the job had died before it could note that the batch was done
    for crc in glob.glob(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    again = run().drop("batch_id")
    assert sorted(map(str, again.collect())) == first
    return again.collect()


def test_numbers_go_on_and_repeated_batches_change_nothing(spark, tmp_path):
    from tidewell.streaming import jobs

    batches = [[("a", 2, 0), ("a", 1, 0), ("b", 1, 0)], [("a", 3, 0), ("c", 9, 0), ("c", 8, 0)], [("b", 2, 0)]]
    got = _fed(spark, tmp_path, jobs.stream_numbered, batches, "thread_id string, pos long, created_at timestamp")
    assert sorted((r["thread_id"], r["pos"], r["seq"]) for r in got) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("b", 2, 2), ("c", 8, 1), ("c", 9, 2)]


def test_debounce_puts_each_session_out_once(spark, tmp_path):
    from tidewell.streaming import jobs

    u = lambda agent, text, c, r, at: ("t", "u", agent, text, c, r, at)
    batches = [
        [u("x", "one", False, False, 0), u("x", "two", True, False, 20), u(None, "lead", False, True, 5)],
        [u("x", "late", False, True, 35), u("x", "between", False, False, 25), u("y", "other", False, False, 50)],  # a timer moved on, a late update
        [u("z", "far", False, False, 200)],  # the watermark passes all others
        [u("z", "end", False, False, 1000)],
    ]
    got = _fed(spark, tmp_path, lambda s: jobs.stream_memory_debounce(s, "30 seconds"), batches, "thread_id string, user_id string, agent string, content string, correction boolean, reinforcement boolean, created_at timestamp")
    assert sorted((r["agent"], r["start"].minute * 60 + r["start"].second, r["transcript"], r["correction"], r["reinforcement"], r["updates"]) for r in got) == [
        ("", 5, "lead", False, True, 1), ("x", 0, "late", True, True, 4), ("y", 50, "other", False, False, 1), ("z", 200, "far", False, False, 1),
    ]


def test_guards_keep_state_by_tool_and_message(spark, tmp_path):
    from tidewell.streaming import jobs

    call = lambda turn, name, h_, at: ("t", turn, name, h_, at)
    batches = [[call(1, "a", "h", 0), call(2, None, "h", 1)], [call(3, "a", "h", 2), call(4, "a", "i", 3)], [call(5, "b", "h", 9_000), call(6, "a", "h", 9_001)], [call(7, "a", "h", 30_000)], [call(8, "a", "h", 30_001)]]
    got = _fed(spark, f"{tmp_path}/calls", lambda s: jobs.stream_loop_guard(s, 20, 3, 5, 2, 4, 3_600_000), batches, "thread_id string, turn long, name string, hash string, created_at timestamp")
    # after turn 6 the thread is idle: its state goes with the watermark, so turn 8 begins anew after 7 moved that on
    assert [(r["turn"], r["call_state"], r["tool_state"]) for r in sorted(got, key=lambda r: r["turn"])][:6] == [(1, "ok", "ok"), (2, "ok", "ok"), (3, "warn", "warn"), (4, "ok", "ok"), (5, "ok", "ok"), (6, "hard", "hard")]
    use = lambda m, total, pos, at: ("r", m, total, pos, at)
    batches = [[use("m", 50, 1, 0), use("m", 70, 2, 1)], [use("n", 20, 3, 2), use("m", 60, 4, 3)], [use("m", None, 5, 4), use(None, 40, 6, 5)]]
    got = _fed(spark, f"{tmp_path}/use", lambda s: jobs.stream_budget_guard(s, 100), batches, "run_id string, message_id string, total_tokens long, pos long, created_at timestamp")
    assert [(r["pos"], r["used"], r["state"]) for r in sorted(got, key=lambda r: r["pos"])] == [(1, 50, "ok"), (2, 70, "ok"), (3, 90, "warn"), (4, 90, "ok"), (5, 90, "ok"), (6, 130, "hard")]


class _Calls:
    """A store of state for one key that counts what is asked of it."""

    def __init__(self):
        self.n, self.value, self.entries, self.timers = 0, None, {}, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            elif name == "updateValue":
                self.entries[args[0]] = args[1]
            elif name == "registerTimer":
                self.timers.append(args[0])
            return self.value if name == "get" else self.value is not None if name == "exists" else self.entries.get(args[0]) if name == "getValue" else None

        return call


def test_a_run_costs_few_calls_of_its_state():
    from pyspark.sql import Row

    from tidewell.streaming import jobs

    guard, calls = jobs._BudgetGuard(100, 0.8, 1.0, 1000), _Calls()
    guard.init(calls)
    row = lambda m, total, pos: Row(run_id="r", message_id=m, total_tokens=total, pos=pos, at_ms=pos)
    assert [r.used for r in guard.handleInputRows(("r",), iter([row("b", 7, 2), row("a", 5, 1), row("a", 6, 3)]), None)] == [5, 12, 13]
    assert calls.n == 3 and calls.timers == [1003]
    # more messages than the value holds: each keeps its own total
    got = list(guard.handleInputRows(("r",), iter([row(f"m{i}", 1, 4 + i) for i in range(100)]), None)) + list(guard.handleInputRows(("r",), iter([row(f"m{i}", 3, 200 + i) for i in range(100)]), None))
    assert got[-1].used == 13 + 300 and len(calls.entries) == 100 + 2 - guard.INLINE


def test_sessions_of_a_key_cost_few_calls_of_its_state():
    import pandas as pd

    from tidewell.streaming import jobs

    class Time:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 10**9

    bounce, calls = jobs._Debounce(1000), _Calls()
    bounce.init(calls)
    at = pd.to_datetime([2 * i for i in range(300)], unit="s")  # each a session of its own
    assert list(bounce.handleInputRows(("t", "u", "x"), iter([pd.DataFrame({"created_at": at, "content": "c", "correction": False, "reinforcement": True})]), None)) == []
    (out,) = bounce.handleExpiredTimer(("t", "u", "x"), Time(), Time())
    assert len(out) == 300 and out["start"].is_unique and calls.n < 10 and calls.value is None


def test_python_over_whole_texts_gets_bounded_batches(spark, sf_dir):
    """Queries that hand whole texts to Python set limits to a batch; ASCII texts are folded without Python."""
    from tidewell.plans import registry
    from tidewell.sources.shared import BATCH_LIMITS

    for name in ("c9_redact_json", "c20_page_article", "c20_page_texts", "i6_merge_facts", "i6_merge_facts_whole"):
        for key in BATCH_LIMITS:
            spark.conf.unset(key)
        registry.queries()[name](spark, sf_dir)
        assert {k: spark.conf.get(k) for k in BATCH_LIMITS} == BATCH_LIMITS, name
    texts = [None, "", " \x1c\x85 ", "\t\x1f Ab\x0b", "\xa0STRASSE Straße", "İI\u0131", "A\x00 ", "\x7f x"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", h.folded("text").alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == [None if x is None else x.strip().casefold() for x in texts]


def test_csv_records_are_put_together_once(spark, tmp_path):
    (tmp_path / "o.csv").write_text('k,v\n1,"a\nb"\n2,c\n')
    df = files.load_csv(spark, [f"{tmp_path}/o.csv"])["o"]
    assert sorted(map(tuple, df.collect())) == [(1, "a\nb"), (2, "c")]
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_grep_folds_letters_of_all_scripts(spark):
    f = spark.createDataFrame([("a.md", "Über ÄRGER\nnichts\nnaïve\rx")], "path string, text string")
    hits = lambda p, **k: [r["line_number"] for r in corpus.grep(f, p, **k).collect()]
    assert hits("ärger", case_sensitive=False) == [1] and hits("ärger") == [] and hits("ärger", literal=True, case_sensitive=False) == [1] and hits(r"\bnaïve\b") == [3] and hits(r"^\w+$") == [2]


def test_metadata_keeps_types(spark):
    t = spark.createDataFrame([("1", "a", '{"n":1,"b":true,"o":{"x":[1]},"s":"t"}'), ("2", None, '{"n":1}'), ("3", "a", None)], "thread_id string, user_id string, metadata string")
    p = spark.createDataFrame([("1", "a", '{"n":null,"z":[1.5,"q"]}'), ("2", "a", '{"n":2}'), ("3", None, '{"k":false}')], "thread_id string, user_id string, metadata string")
    got = {r["thread_id"]: json.loads(r["metadata"]) for r in events.merge_metadata(t, p).collect()}
    assert got == {"1": {"n": None, "b": True, "o": {"x": [1]}, "s": "t", "z": [1.5, "q"]}, "2": {"n": 1}, "3": {"k": False}}
    assert events.merge_metadata(t, p).where(events.metadata_equals("metadata", "b", True)).count() == 1


def test_budgets_of_outputs(spark):
    lines = "\n".join(f"line {i}" for i in range(3000))
    df = spark.createDataFrame([("grep", lines, "/o/x"), ("grep", lines * 2, None), ("grep", "short", "/o/y"), ("read_file", lines * 2, None), ("grep", "z" * 40_000, None)], "tool string, text string, path string")
    got = [r[0] for r in df.select(tx.budget_output("text", "tool", "path")).collect()]
    head, tail = got[0].split("\n\n[Full grep output saved to /o/x (")[0], got[0].split("this preview.]\n\n")[1]
    assert lines.startswith(head) and head.endswith("\n") and len(head) <= 2000 and lines.endswith(tail) and tail.startswith("line ") and f"{len(lines) - len(head) - len(tail)} chars omitted" in got[0]
    assert len(got[1]) <= 30_000 and "chars omitted from grep output. Persistent storage unavailable." in got[1] and got[2] == "short" and got[3] == lines * 2
    assert len(got[4]) <= 30_000 and got[4].startswith("z" * 8000 + "\n\n[... 29000 chars")
    assert [r[0] for r in df.select(tx.budget_output("text", "tool", None, most=20)).collect()][2:] == ["short", lines * 2, "z" * 20]
    saved = messages.stored_outputs(df.withColumn("call_id", F.lit(7)).withColumn("tool", F.lit("a/../b\\c"))).collect()
    assert len(saved) == 4 and saved[0]["path"] == ".tool-results/b_c-" + hashlib.md5(b"7").hexdigest()[:12] + ".txt" and saved[0]["text"] == lines


def test_traces(spark):
    df = spark.createDataFrame([("trace", json.dumps("é" * 10)), ("trace", '{"a": "' + "x" * 30 + '"}'), ("message", '{"a": 1}'), ("trace", "[1]"), ("message", "no json"), ("trace", None)], "c string, v string")
    got = [tuple(r) for r in df.select(h.trace_content("c", "v", 11).alias("s")).select("s.*").collect()]
    assert got == [("é" * 5, True, 20, False, False), ('{"a": "xxxx', True, 39, False, False), ('{"a": 1}', False, None, True, True), ("[1]", False, None, True, False), ("no json", False, None, False, False), (None, False, None, False, False)]


def test_sections_search(spark):
    s = spark.createDataFrame([("Work", "likes tea"), ("Tea time", None), ("x", "y")], "title string, summary string")
    assert sorted(r["title"] for r in messages.search_sections(s, "TEA").collect()) == ["Tea time", "Work"]


def test_symbols_and_pages():
    assert h.symbols_of("class A:\n  def b(self): pass\n", "python") == [("A", 1), ("b", 2)]
    assert h.symbols_of("def broken(", "python") == []
    assert h.symbols_of("type T struct {}\nfunc (t T) Go() {}", "go") == [("T", 1), ("Go", 2)]
    title, body, images = h.page_of("<title> A b</title><script>no()</script><h2>H</h2><p>x &amp; y</p><img src=i.png>")
    assert (title, images) == ("A b", ["i.png"]) and "## H" in body and "x & y" in body and "no()" not in body
    assert h.page_of(None) == ("Untitled", "No content could be extracted from this page", [])
    page = "<body><nav>menu</nav><ul><li><a href=a>One</a></li><li><a>Two</a> x</li></ul><main><h1>H</h1><p>Long text with a <a>link</a> in it.</p><ul><li>point</li></ul></main><p>Short note</p><footer>Terms</footer></body>"
    assert h.page_of(page)[1] == "# H\n\nLong text with a link in it.\n\n- point"
    assert h.page_of("<p>Plain <b>bold</b> text</p><div><a>Next page</a></div><aside>ad</aside>")[1] == "Plain bold text" and h.page_of("<a>Only</a> <p><a>links</a></p>")[1] == "Only\n\nlinks"
    assert h.page_of("<article>tiny</article>" + "<p>" + "word " * 40 + "</p>")[1].startswith("tiny\n\nword")


def test_todo_changes():
    was = [("a", "pending"), ("b", "in_progress"), ("a", "pending"), ("old", "pending")]
    now = [("a", "completed"), ("a", "pending"), (None, "pending"), ("new", "in_progress"), ("b", None)]
    got = h.todo_changes(was, now)
    assert got == [{"kind": "todo_complete", "content": "a"}, {"kind": "todo_update", "content": "new"}, {"kind": "todo_update", "content": "b"}]
    assert h.todo_changes([("a", "pending"), ("b", "pending")], [("b", "pending")]) == [{"kind": "todo_remove", "content": "a"}]
    assert h.todo_changes([], [("a", "in_progress"), ("b", "completed"), ("c", "pending")]) == [{"kind": k, "content": c} for k, c in (("todo_start", "a"), ("todo_complete", "b"), ("todo_update", "c"))]


def test_attribution():
    todos = lambda *xs: json.dumps([{"content": c, "status": s} for c, s in xs])
    write = lambda *xs: json.dumps({"todos": json.loads(todos(*xs))})
    kind = lambda calls, text=None, before=None: h.attribution(calls, text, before)["kind"]
    assert kind([("write_todos", write(("a", "completed")), "1")], before=todos(("a", "pending"))) == "todo_update"
    assert kind([("write_todos", write(("a", "pending")), "1")], before=todos(("a", "pending"))) == "tool_batch"
    assert [kind(c, t) for c, t in (([("task", "{}", "1")], ""), ([("task", "{}", "1"), ("task", "{}", "2")], ""), ([], "hi"), ([], ""))] == ["subagent_dispatch", "tool_batch", "final_answer", "thinking"]
    got = h.attribution([("web_search", '{"query": " q "}', "1"), ("present_files", None, " "), ("ask_clarification", "[]", None), (" ", '{"description": "d"}', "4"), ("task", '{"description": "t", "subagent_type": "x"}', "5")], None, "not json")
    assert [a["kind"] for a in got["actions"]] == ["search", "present_files", "clarification", "tool", "subagent"] and got["tool_call_ids"] == ["1", "4", "5"] and got["shared_attribution"]
    assert got["actions"][0]["query"] == "q" and got["actions"][3]["tool_name"] == "unknown" and got["actions"][4]["subagent_type"] == "x" and got["actions"][1]["tool_call_id"] is None
    twice = h.attribution([("write_todos", write(("a", "pending")), "1"), ("write_todos", write(("a", "completed")), "2")], None, None)
    assert [a["kind"] for a in twice["actions"]] == ["todo_update", "todo_complete"]


def test_branch():
    make = lambda strategy="ANCHORED_CONTEXT", budget=300, **k: h.branch(**({"anchor": " anchor ", "question": "why?", "summary": "a  b", "relevant": ["r1", "r2"], "main": ["m1"], "history": ["old", "new"], "code": ["c1"], "budget": budget, "strategy": strategy} | k))
    prompt, cut, error = make()
    assert error is None and not cut and "<anchor>\nanchor\n</anchor>" in prompt and "- r1\n- r2" in prompt and "- old\n- new" in prompt and "m1" not in prompt and "\nc1\n" in prompt and "\na b\n" in prompt
    assert "- m1" in make("FULL_HISTORY")[0] and "r1" not in make("FULL_HISTORY")[0] and "c1" not in make("ANCHOR_ONLY")[0] and "- new" in make("ANCHOR_ONLY")[0]
    prompt, cut, _ = make(budget=600, history=["x" * 600, "y" * 500, "z" * 100], code=["k" * 5000])
    assert cut and "xxx" not in prompt and "y" * 500 + "\n- " + "z" * 100 in prompt and "kkk" not in prompt and len(prompt) // 4 <= 600  # whole entries go, none is cut
    assert make(anchor="a" * 1300)[::2] == (None, "anchor and question over the budget") and make(budget=100)[2] and make(question=" ")[2] and make("x")[2]
    prompt, cut, error = make(anchor="a" * 1000, history=["h"])
    assert prompt is None and error.startswith("no room")


def test_packed_context(spark):
    import pytest

    rows = [("q", i + 1, f"p{i}", 1, 9, 0.5, "why", t) for i, t in enumerate(["a" * 100, "b" * 9000, "c"])] + [("r", 1, "p", 1, 1, 1.0, "w", " ")]
    hits = spark.createDataFrame(rows, "query_id string, rank int, path string, start_line int, end_line int, score double, reason string, text string")
    got = {r["query_id"]: r for r in corpus.pack_context(hits, 200).collect()}
    q = got["q"]
    assert len(q["prompt"]) == 800 and q["chunks"] == 2 and q["truncated"] and q["estimated_tokens"] == 200 and '<code_chunk path="p0" lines="1-9" score="0.5000" reason="why">\n' + "a" * 100 + "\n</code_chunk>\n" in q["prompt"]
    assert got["r"]["prompt"] == "<retrieved_code_context>\n</retrieved_code_context>" and got["r"]["truncated"] and got["r"]["chunks"] == 0
    assert "b" * 6000 + "\n</code" in corpus.pack_context(hits, 4000).where("query_id = 'q'").first()["prompt"]
    with pytest.raises(ValueError):
        corpus.pack_context(hits, 127)


def test_task_status(spark):
    texts = ("Task Succeeded. Result: x", " Task polling timed out after", "Task timed out. Error", "Task cancelled by user.", "Task failed. Error: y", "Error: z", "still working", None)
    assert one(spark, tx.task_status("x"), *texts) == ["completed", "polling_timed_out", "timed_out", "cancelled", "failed", "failed", None, None]


def test_texts(spark):
    assert one(spark, tx.estimate_tokens("x"), "abcdefgh", "漢字かな", None) == [2, 2, 0]
    assert one(spark, tx.redact_text("x"), "Authorization: Bearer abc", "see /home/bob/x sk-12345678") == ["Authorization: Bearer <redacted>", "see /home/<user>/x sk-<redacted>"]
    assert one(spark, tx.sanitize_input("x"), " ", "a<System x>b</system>") == [" ", f"{tx.INPUT_BEGIN}\na&lt;System x&gt;b&lt;/system&gt;\n{tx.INPUT_END}"]
    wrapped = f"{tx.INPUT_BEGIN}\nok\n{tx.INPUT_END}"
    assert one(spark, tx.sanitize_input("x"), wrapped) == [wrapped]
    assert one(spark, tx.parse_choice("x"), "B", "the answer is (c)", "Answer: D.", "none") == ["B", "C", "D", None]
    assert one(spark, tx.parse_memory("x"), "1Ki", "1.5M", "7", "x", None) == [1024, 1500000, 7, None, None]
    assert one(spark, tx.parse_cpu("x"), "250m", "2", "bad") == [250, 2000, None]
    assert sorted(one(spark, tx.tokenize("x"), "def f_1 漢字仮")[0]) == sorted(["def", "f_1", "漢字仮", "漢字", "字仮"])
    assert one(spark, tx.message_text("x", "\n"), '["a", {"text": "b"}, {"content": "c"}]', "plain", '{"text": "t"}') == ["a\nb\nc", "plain", "t"]


def test_typed_metadata(spark):
    t = spark.createDataFrame([("1", '{"k": 1}'), ("2", '{"k": true}'), ("3", '{"k": null}'), ("4", "{}"), ("5", '{"k": "1"}'), ("6", '{"k": 1.0}')], "id string, metadata string")
    ids = lambda v: [r[0] for r in t.where(events.metadata_equals("metadata", "k", v)).orderBy("id").collect()]
    assert [ids(1), ids(True), ids(None), ids("1"), ids(1.0)] == [["1"], ["2"], ["3"], ["5"], ["1", "6"]]


def test_signals(spark):
    rows = [("a", 1, "human", "That's wrong, redo"), ("b", 1, "human", "Perfect!"), ("c", 1, "human", "ok"), ("d", 1, "human", "你理解错了"), ("e", 1, "ai", "redo")]
    got = messages.signal_flags(spark.createDataFrame(rows, "thread_id string, turn int, type string, content string"))
    assert sorted(map(tuple, got.collect())) == [("a", True, False), ("b", False, True), ("c", False, False), ("d", True, False), ("e", False, False)]


def test_casefolded_merge(spark):
    old = spark.createDataFrame([("u", "Straße")], "user_id string, content string")
    new = spark.createDataFrame([("u", " STRASSE", 0.9, 1), ("u", "b", 0.9, 2), ("u", "B ", 0.9, 3), ("u", "c", 0.1, 4)], "user_id string, content string, confidence double, pos int")
    assert [r["content"] for r in messages.merge_facts(old, new).collect()] == ["b"]


def test_glob_patterns():
    hit = lambda p, s: re.search(corpus.glob_regex(p), s) is not None
    assert hit("*.py", "a/b.py") and hit("**/*.py", "b.py") and not hit("*.py", "b.pyc") and hit("src/*.go", "x/src/a.go") and not hit("src/*.go", "src/x/a.go") and hit("[ab].md", "a.md")


def test_outline_limit(spark):
    md = "\n".join(f"# h{i}" for i in range(60))
    got = corpus.extract_outline(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md")
    assert got.count() == 50 and got.where("truncated").count() == 50


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "query string, should_trigger boolean, triggered boolean")
    assert evals.trigger_eval(empty).count() == 0
    assert evals.confusion(spark.createDataFrame([], "a boolean, b boolean"), "a", "b").first()["accuracy"] == 0.0


def test_benchmark_runs(spark, tmp_path):
    for cfg, n, rate in (("with", 1, 1.0), ("with", 2, 0.5), ("without", 1, 0.25)):
        d = tmp_path / "eval-3" / cfg / f"run-{n}"
        d.mkdir(parents=True)
        (d / "grading.json").write_text(json.dumps({"summary": {"pass_rate": rate}, "execution_metrics": {"output_chars": 9}}))
        if n == 1:
            (d / "timing.json").write_text('{"total_duration_seconds": 2.5, "total_tokens": 7}')
    (tmp_path / "eval-3" / "with" / "run-9").mkdir()
    (tmp_path / "eval-3" / "with" / "run-9" / "grading.json").write_text("{bad")
    (tmp_path / "eval-3" / "eval_metadata.json").write_text('{"eval_id": 11}')
    got = files.read_benchmark_runs(spark, str(tmp_path)).select("eval_id", "configuration", "run_number", "pass_rate", "time_seconds", "tokens")
    assert sorted(map(tuple, got.collect())) == [(11, "with", 1, 1.0, 2.5, 7), (11, "with", 2, 0.5, 0.0, 9), (11, "without", 1, 0.25, 2.5, 7)]


def test_corpus_and_tasks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("\n\nx = 1\n y\nz\nw\n")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "node_modules" / "c.js").write_text("no")
    got = files.scan_corpus(spark, str(tmp_path)).collect()
    assert [(r["language"], r["summary"]) for r in got] == [("python", "x = 1 y z")]
    (tmp_path / "p" / "t1").mkdir(parents=True)
    (tmp_path / "p" / "t1" / "task.json").write_text(json.dumps({"project_id": "p", "task_id": "t1", "status": "failed", "attempt_count": 1, "max_attempts": 2}, indent=1))
    m = evals.task_metrics(files.read_tasks(spark, str(tmp_path / "p"))).first()
    assert (m["total"], m["failed"], m["retryable"], m["n_completed"]) == (1, 1, 1, 0)


def test_strict_access(spark):
    threads = spark.createDataFrame([("t1", "u1"), ("t2", None)], "thread_id string, user_id string")
    req = spark.createDataFrame([("t1", "u1"), ("t1", "u2"), ("t2", "u2"), ("t3", "u1")], "thread_id string, user_id string")
    ok = lambda strict: [r["allowed"] for r in events.thread_access(req, threads, strict).orderBy("thread_id", "user_id").collect()]
    assert ok(False) == [True, False, True, True] and ok(True) == [True, False, True, False]


def test_budget_goes_by_growth(spark):
    u = spark.createDataFrame([("r", "m", 50, 1), ("r", "m", 70, 2), ("r", "n", 20, 3), ("r", "n", 40, 4)], "run_id string, message_id string, total_tokens long, pos long")
    assert [(r["used"], r["state"]) for r in events.token_budget(u, 100).orderBy("pos").collect()] == [(50, "ok"), (70, "ok"), (90, "warn"), (110, "hard")]


def test_pack_facts_stops_at_the_first_over_budget(spark):
    f = spark.createDataFrame([("u", "a" * 40, "k", 0.9, 1), ("u", "b" * 400, "k", 0.8, 2), ("u", "c", "k", 0.7, 3), ("u", "g", "must", 0.1, 4)], "user_id string, content string, category string, confidence double, pos int")
    got = messages.pack_facts(f, 60, ("must",), 20).orderBy("section", "rank").collect()
    assert [(r["section"], r["line"][:16]) for r in got] == [(0, "- [must | 0.10] "), (1, "- [k | 0.90] aaa")]


def test_hybrid_fuses_symbols_text_and_cosine(spark):
    src = [("a.go", "x\ny\nfunc Load() {\n}\nz\nfunc LoadAll() {", "go"), ("b.go", "load load load load load load", "go"), ("c.go", "none", "go")]
    files_ = spark.createDataFrame(src, "path string, text string, language string").withColumn("symbols", h.extract_symbols("text", "language"))
    chunks = corpus.chunk_lines(files_, 4, 2)
    assert sorted((r["path"], r["start_line"], r["symbols"]) for r in chunks.collect()) == [("a.go", 1, ["Load"]), ("a.go", 3, ["Load", "LoadAll"]), ("b.go", 1, []), ("c.go", 1, [])]
    q = spark.createDataFrame([("q", ["load"])], "query_id string, terms array<string>")
    got = corpus.hybrid_retrieve(q, chunks).orderBy("rank").collect()
    want = [("a.go", 3, 0.4, 1.0, 0.61), ("b.go", 1, 1.0, 0.0, 0.65), ("a.go", 1, 0.2, 0.666667, 0.363333)]
    assert [(r["path"], r["start_line"], r["lexical"], r["symbol"], r["score"]) for r in got] == sorted(want, key=lambda x: -x[4])
    many = spark.createDataFrame([(f"q{i}", [w]) for i, w in enumerate(("load", "none", "x", "loadall", "zzz"))], "query_id string, terms array<string>")
    for search in (corpus.hybrid_retrieve, corpus.lexical_retrieve):
        assert sorted(search(many, chunks, index=retrieval.build_index(chunks, block=1)).collect(), key=str) == sorted(search(many, chunks).collect(), key=str)
    v = F.when(F.col("path") == "c.go", F.array(F.lit(1.0), F.lit(0.0))).when(F.col("path") == "b.go", F.array(F.lit(-1.0), F.lit(0.0)))
    got = corpus.hybrid_retrieve(q.withColumn("q", F.array(F.lit(2.0), F.lit(0.0))), chunks.withColumn("embedding", v)).orderBy("rank").collect()
    assert [(r["path"], r["start_line"], r["semantic"], r["score"]) for r in got] == [("a.go", 3, 0.0, 0.48), ("b.go", 1, 0.0, 0.45), ("a.go", 1, 0.0, 0.29), ("c.go", 1, 1.0, 0.25)]


def test_index_equals_scoring_every_chunk(spark):
    """Terms inside tokens, across them, in paths and of one letter, with small blocks, against plain counts; and blocks out of
    reach are not scored."""
    rng = np.random.default_rng(8)
    words = ["load", "loader", "x", "re_load", "été", "漢字", "a.b", "->", "Reload", "b", "  ", "(x)"]
    rows = [(f"dir{i % 5}/f{i // 3}.{'go' if i % 2 else 'été'}", i % 3 + 1, i % 3 + 2, " ".join(rng.choice(words, rng.integers(0, 12))), list(rng.choice(["Load", "x", "Re_loader", "b"], rng.integers(0, 3)))) for i in range(90)]
    chunks = spark.createDataFrame(rows + [("none", 1, 1, None, None)], "path string, start_line int, end_line int, text string, symbols array<string>")
    asks = [["load"], ["a.b", "x"], ["->", ") r"], ["été", "dir3", "字"], ["zzz"], ["loader", "load", "re_loader_x"], ["  "], ["o", "o"], []]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id int, terms array<string>")
    lex = lambda t, r: 3 * (t in r[0].lower()) + min(5, (r[3] or "").lower().count(t))
    sym = lambda t, r: sum(4 if s.lower() == t else 2 if t in s.lower() or s.lower() in t else 0 for s in r[4] or [])
    want = []
    for i, ask in enumerate(asks):
        ask = set(ask)
        a, b = ([sum(f(t, r) for t in ask) for r in rows] for f in (lex, sym))
        fused = [0.65 * (x / max(a) if max(a) else 0) + 0.35 * (y / max(b) if max(b) else 0) for x, y in zip(a, b)]
        best = sorted((-round(f, 6), r[0], r[1]) for f, r in zip(fused, rows) if f > 0)[:4]
        want += [(i, n + 1, *x) for n, x in enumerate(best)]
    for block in (4,):
        got = corpus.hybrid_retrieve(q, chunks, 4, retrieval.build_index(chunks, block)).collect()
        assert sorted((r["query_id"], r["rank"], -r["score"], r["path"], r["start_line"]) for r in got) == want
    assert all(re.fullmatch(r"lexical=[01]\.\d{3}, symbol=[01]\.\d{3}, semantic=unavailable; lines=\d+-\d+", r["reason"]) for r in got)
    assert corpus.pack_context(spark.createDataFrame(got), 200).count() == len({r["query_id"] for r in got})
    # one query for a rare word: of 40 blocks that hold the common one, only those that can reach the best are scored
    hits = spark.createDataFrame([("l", "common", b, b * 10 + i, 1.0) for b in range(40) for i in range(3)] + [("l", "rare", 7, 70, 5.0)], "kind string, term string, block long, cid long, impact double")
    terms = spark.createDataFrame([(1, "common"), (1, "rare")], "query_id int, term string")
    tops = spark.createDataFrame([(1, 6.0, 0.0)], "query_id int, top_lexical double, top_symbol double")
    assert {r["block"] for r in retrieval.best_chunks(terms, hits, tops, 1, 1.0, 0.0, first=1).collect()} == {7}
    assert len({r["block"] for r in retrieval.best_chunks(terms, hits, tops, 2, 1.0, 0.0, first=1).collect()}) == 40  # ties with the second stay in


def test_retrieval_writes_no_row_for_each_query_and_chunk(spark, monkeypatch):
    """A symbol of every chunk that lies in the term of every query, and texts alike: what is written grows with each side alone."""
    from tidewell.operators import products

    made = []
    keep = retrieval.written
    for module in (retrieval, products):
        monkeypatch.setattr(module, "written", lambda df: made.append(keep(df)) or made[-1])
    chunks = spark.range(400).select(F.format_string("f%03d", "id").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("same words").alias("text"), F.array(F.lit("que")).alias("symbols"))
    q = spark.range(60).select(F.col("id").alias("query_id"), F.array(F.concat(F.lit("query"), F.col("id").cast("string")), F.lit("same")).alias("terms"))
    got = corpus.hybrid_retrieve(q, chunks, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["path"], r["score"]) for r in got) == [(i, k + 1, f"f{k:03d}", 1.0) for i in range(60) for k in range(3)]
    assert len(made) > 5 and max(df.count() for df in made) < 60 * 400 / 8


def test_hot_keys_are_scanned_in_blocks(spark, monkeypatch):
    """One key with nine tenths of the rows: same results as windows, and no block with more than a bounded part of it."""
    rng = np.random.default_rng(4)
    n = 6000
    rows = [("hot" if i % 10 else (None if i % 20 else f"k{i % 7}"), int(d), float(a), i) for i, (d, a) in enumerate(zip(rng.integers(0, 900, n), rng.integers(1, 99, n)))]
    df = spark.createDataFrame(rows, "k string, d int, a double, pos long").repartition(7)
    seen, plain = [], scan.blocks
    monkeypatch.setattr(scan, "blocks", lambda *x: seen.append(plain(*x)) or seen[-1])
    want = {r["pos"]: tuple(r) for r in tables.running_total_and_rank(df, "k", "d", "a").collect()}
    assert not seen
    got = {r["pos"]: tuple(r) for r in tables.running_total_and_rank(df, "k", "d", "a", large=400).collect()}
    assert got == want and len(got) == n and len(seen) == 2
    assert max(r["count"] for r in seen[0].groupBy("block").count().collect()) <= 400
    new = df.select(F.col("k").alias("thread_id"), F.col("pos"))
    old = spark.createDataFrame([("hot", 41), ("hot", 7), ("k0", 3)], "thread_id string, seq long")
    plain_seq = {r["pos"]: r["seq"] for r in events.assign_seq(new, old).collect()}
    assert {r["pos"]: r["seq"] for r in events.assign_seq(new, old, large=500).collect()} == plain_seq and plain_seq[1] == 42 and len(plain_seq) == n
    u = df.select(F.col("k").alias("run_id"), (F.col("pos") % 11).cast("string").alias("message_id"), F.col("a").cast("long").alias("total_tokens"), "pos")
    as_set = lambda d: sorted(map(str, d.select("run_id", "message_id", "pos", "used", "state").collect()))
    assert as_set(events.token_budget(u, 9_000)) == as_set(events.token_budget(u, 9_000, large=300))


def test_split_ranks_only_the_cut_bucket(spark):
    rows = [(i, "a" if i % 9 else "b") for i in range(2000)] + [(5000, None), (None, "a"), (None, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "id long, s string")
    got = evals.stratified_split(df, "s", "id", 0.3).collect()
    digest = lambda i: hashlib.md5(f"42:{'' if i is None else i}".encode()).hexdigest()
    assert len(got) == len(rows)
    for stratum in ("a", "b", None):
        of = sorted(((digest(r["id"]), str(r["id"]), r["is_test"]) for r in got if r["s"] == stratum), key=lambda x: (x[0], not x[2]))
        k = max(1, len(of) * 3 // 10)
        assert [x[2] for x in of] == [True] * k + [False] * (len(of) - k)


def test_best_run_equals_all_runs():
    rng = np.random.default_rng(5)
    for _ in range(600):
        x = rng.integers(-4, 5, rng.integers(0, 14)).tolist()
        sums = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        lo, hi = h.best_run(x)
        top = max(sums.values(), default=0)
        assert (lo, hi) == (0, 0) if top <= 0 else sum(x[lo:hi]) == top


def test_main_content_of_all_pages(spark, sf_dir):
    """Every given page against all runs of its blocks, and its article's paragraphs inside."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["body"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", h.page_article("html").alias("a")).select("page_id", "a.body").collect()}
    for page_id, html in pages:
        page = h._Page()
        page.feed(html or "")
        page.close()
        found = [b for b in page.blocks if b[1].strip()]
        inside = [b for b in found if b[3]]
        plain = lambda bs: sum(len(b[1].strip()) - b[2] for b in bs)
        of = inside if inside and 4 * plain(inside) >= plain(found) else found
        worth = [len(b[1].strip()) - 4 * b[2] for b in of]
        upto = np.concatenate(([0], np.cumsum(worth)))
        top = max((upto[j] - upto[:j].min() for j in range(1, len(upto))), default=0)
        runs = {"\n\n".join(b[0] + b[1].strip() for b in of[i:j])[:4096] for j in range(1, len(upto)) for i in np.flatnonzero(upto[j] - upto[:j] == top)} if top > 0 else {"\n\n".join(b[0] + b[1].strip() for b in found)[:4096] or "No content could be extracted from this page"}
        assert got[page_id] in runs


def test_decimals_round_as_the_exact_value(spark):
    xs = [i / 80 for i in range(81)] + [0.0625, 0.3125, 0.56875, 1 / 3, 1.0, 0.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", retrieval.fixed(F.col("x"), 3).alias("a"), retrieval.fixed(F.col("x"), 4).alias("b")).collect()
    assert all(r["a"] == f"{r['x']:.3f}" and r["b"] == f"{r['x']:.4f}" for r in got)


def test_grep_takes_lines_one_by_one(spark):
    texts = ["one\nfoo bar\nfoo", "foo\n\nbar foo\n", "Straße\nSTRASSE x\nfoo.bar", "a\tb\nab\n aab", ""]
    f = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string")
    patterns = [r"\Afoo", r"(?<!\s)foo", r"^foo$", r"foo\Z", r"fo+ b", r"(fo){1,2}o", r"(?:ba|fo)[or]+", r"a?b", r"(?=foo)f", r"x|foo", r"\bbar\b", r"a{2}b", r"foo\.bar", r"(a)(b)", r"a\tb", r"^$", r"(?!foo)b"]
    for p in patterns:
        want = [(f"p{i}", n + 1) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if re.search(p, line)]
        assert [(r["path"], r["line_number"]) for r in corpus.grep(f, p).collect()] == want, p
    assert corpus.required_literals(r"(?<=x)foo(bar|kin)(qu+x)?end") == ["end", "foo"] and corpus.required_literals("(?i)foo") == [] and corpus.required_literals("(") == []
    assert corpus.required_literals(r"a(bc)+d") == ["bc", "a", "d"]
    assert corpus.grep(f, "a\nb", literal=True).count() == 0 and [r["line_number"] for r in corpus.grep(f, "strasse", case_sensitive=False).collect()] == [2]


def test_metadata_patches_of_a_thread_are_folded(spark):
    t = spark.createDataFrame([("t", "u", '{"a": 1}'), ("s", None, None), ("r", "u", '{"z": 1}')], "thread_id string, user_id string, metadata string")
    p = spark.createDataFrame([("t", "u", '{"b": 1, "c": [1]}', 1), ("t", None, '{"b": 2.5}', 2), ("t", "other", '{"b": 9}', 3), ("s", "u", '{"x": 1}', 1), ("s", None, '{"y": null}', 2)], "thread_id string, user_id string, metadata string, pos int")
    got = {r["thread_id"]: r["metadata"] and json.loads(r["metadata"]) for r in events.merge_metadata(t, p).collect()}
    assert got == {"t": {"a": 1, "b": 2.5, "c": [1]}, "s": {"y": None}, "r": {"z": 1}}


def test_run_summary_takes_the_lead_agent_only(spark):
    rows = [("r", 1, False, "sub", "subagent:a"), ("r", 2, False, "hi", "lead_agent"), ("r", 3, True, " answer \n", None), ("r", 4, True, "   ", "lead_agent"), ("r", 5, True, "inner", "subagent:a"), ("s", 1, True, "x", "middleware:b")]
    e = spark.createDataFrame([(*r, "message") for r in rows], "run_id string, seq int, is_ai boolean, content string, caller string, category string")
    assert sorted(tuple(r) for r in events.run_message_summary(e).collect()) == [("r", 5, "hi", "answer"), ("s", 1, None, None)]


def test_semantic_takes_every_fiftieth_row_in_blocks(spark, tmp_path):
    from tidewell.plans import registry

    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (460, 6)).astype(float)  # many ties, some rows of zeros
    x[[50, 70]] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(460, None), (461, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (462, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    n = np.linalg.norm(x, axis=1)
    want = []
    for i in range(0, 460, 50):
        if n[i]:
            s = [(-round(float(max(0.0, min(1.0, x[i] @ x[j] / (n[i] * n[j])))), 6), j) for j in range(460) if n[j]]
            want += [(i, r + 1, j, -c) for r, (c, j) in enumerate(sorted(s)[:5])]
    got = registry.queries()["g7_semantic_retrieve_fiftieth"](spark, str(tmp_path))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == want
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    cut = corpus.semantic_retrieve(e.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as q"), e, query_block=3, row_block=40)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cut.collect()) == want


def test_facts_hold_the_whole_text(spark, tmp_path):
    from tidewell.plans import registry

    same = "x" * 60
    rows = [(1, same + " the end", "en", "s", 80), (2, same, "en", "s", 60), (3, same + " more", "en", "s", 90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda name: sorted(r["id"] for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert ids("b8_search_facts_whole") == ["1"] and ids("i6_merge_facts_whole") == ["1", "3"]
    assert registry.queries()["c13_normalize_facts_whole"](spark, str(tmp_path)).where("id = '1'").first()["content"] == same + " the end"


def test_streaks_and_turns_of_hot_threads_go_over_blocks(spark):
    """Nine tenths of the rows in one thread, streaks longer than blocks, rows without a key: as a plain walk gives them."""
    rng = np.random.default_rng(5)
    kinds = [("a", 700), (None, 40), ("b", 1), ("b", 300), ("a", 3), (None, 1), (None, 2), ("c", 500)] + [(str(x), int(n)) for x, n in zip(rng.integers(0, 2, 200), rng.integers(1, 6, 200))]
    values = [k for k, n in kinds for _ in range(n)]
    rows = [("hot", i, v) for i, v in enumerate(values)] + [(None if i % 2 else "cold", i // 2, "x" if i % 20 < 12 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(5)
    expected = {}
    for key in ("hot", "cold", None):
        before, n = None, 0
        for _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            n = 0 if v is None else n + 1 if v == before else 1
            before, expected[key, i] = v, n
    for large in (1_000_000, 400, 90):
        got = scan.streaks(df, ["k"], [F.col("i")], "v", "n", large)
        assert got.columns == ["k", "i", "v", "n"] and {(r["k"], r["i"]): r["n"] for r in got.collect()} == expected
    assert scan.streaks(df.limit(0), ["k"], [F.col("i")], "v", "n").count() == 0
    e = df.selectExpr("k as thread_id", "i as turn", "v as blocker", "' t ' as text", "v is null as success", "1 as start", "2 as island")
    as_rows = lambda d: sorted(map(str, d.collect()))
    whole = messages.no_progress(e)
    assert whole.columns == [*e.columns, "streak"] and as_rows(whole) == as_rows(messages.no_progress(e, large=300))
    assert {(r["thread_id"], r["turn"]): r["streak"] for r in whole.collect()} == expected
    m = df.selectExpr("k as thread_id", "i as turn", "case when v is null then null when i % 3 = 0 then 'human' else 'ai' end as type", "i as input_tokens", "1 as output_tokens")
    assert as_rows(messages.turn_usage(m)) == as_rows(messages.turn_usage(m, large=300))


def test_semantic_search_skips_blocks_and_loses_nothing(spark):
    """Clustered vectors with a cluster of equal rows, several lengths, odd vectors: rows as by scoring all, few blocks scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = [(i, (centres[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(3000)]
    v += [(3000 + i, centres[0].tolist()) for i in range(1500)] + [(5000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    v += [(6000, None), (6001, [0.0] * 8), (6002, [1.0, None, 2.0]), (6003, [float("nan")] * 8), (6004, [float("inf")] + [1.0] * 7), (6005, [])]
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).repartition(4)
    queries = vectors.where("vec_id % 97 = 0 or vec_id > 5030").selectExpr("vec_id as query_id", "embedding as q", "'y' as block")
    usable = {i: np.array(x) for i, x in v if x and None not in x and np.isfinite(x).all() and any(x)}
    asked = {r["query_id"] for r in queries.collect()} & usable.keys()

    def brute(k):
        for i in asked:
            q = usable[i]
            s = sorted((-round(float(np.clip(q @ x / np.sqrt((q @ q) * (x @ x)), 0, 1)), 6), j) for j, x in usable.items() if len(x) == len(q))
            yield from ((i, n + 1, j, -score) for n, (score, j) in enumerate(s[:k]))

    found = nearest.search(queries, vectors, 7, query_block=20, row_block=100)
    got = found.hits.select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute(7))
    blocks = {(r["dim"], r["cell"], r["block"]): r["n"] for r in found.blocks.collect()}
    assert sum(blocks.values()) == len(usable) and max(blocks.values()) < 400  # equal rows are cut as well
    seen = [(r["qid"], r["dim"], r["cell"], r["block"]) for r in found.visits.collect()]
    assert len(seen) == len(set(seen)) and sum(blocks[s[1:]] for s in seen) < 0.6 * len(asked) * len(usable)
    everything = nearest.semantic_retrieve(queries, vectors, 5000, row_block=1000)
    assert everything.where("query_id = 0").count() == 4500 and everything.where("query_id = 5031").count() == 40
    for q, x in ((queries.limit(0), vectors), (queries, vectors.limit(0))):
        assert nearest.semantic_retrieve(q, x).count() == 0


def _as_sql(spark, folder, name, texts):
    """Rows of a query and of its SQL over documents of these texts, in each remainder by 60."""
    import duckdb

    from tidewell.plans import registry

    rows = [(60 * i + j, t, ("en", "de", None)[j % 3], "s", None if j == 8 else len(t or "")) for i, t in enumerate(texts) for j in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    return sorted(map(repr, map(tuple, registry.queries()[name](spark, str(folder)).select(*columns).collect()))), sorted(map(repr, want.fetchall()))


BLANKS = ["", "  ", "\n \n", "\t", "a", " a b \n", "\ta\r\n", "\xa0a \xa0 b\u3000", "\u2028", "\x0ba\x1c\x0bb\x85", None]


def test_normalized_facts_keep_blank_texts_as_their_sql_does(spark, tmp_path):
    got, want = _as_sql(spark, tmp_path, "c13_normalize_facts", BLANKS)
    assert got == want and len(got) == len(BLANKS) * 40
    f = spark.createDataFrame([("1", " \xa0", None, "1"), ("2", "\tb\n", " x ", '"0.5"'), ("3", "c", "y", None)], "id string, content string, category string, confidence string")
    plain, kept = messages.normalize_facts(f), messages.normalize_facts(f, " \n", blank=True)
    assert [tuple(r) for r in plain.collect()] == [("2", "b", "x", 0.5)]
    assert sorted(map(tuple, kept.collect())) == [("1", "\xa0", None, 1.0), ("2", "\tb", "x", 0.5), ("3", "c", "y", None)]


def test_page_articles_of_odd_texts_are_as_their_sql_says(spark, tmp_path):
    got, want = _as_sql(spark, tmp_path, "c20_page_article", BLANKS)
    assert got == want and len(got) == len(BLANKS) * 60
    assert h.page_of("<title>a\xa0 b </title><p> x\xa0 \n y\u3000</p><p> </p>")[:2] == ("a\xa0 b", "x\xa0 y")


def test_retrieval_keeps_texts_where_they_lie(spark, monkeypatch):
    """No row for each word of a text is written, texts cross no shuffle, and chunks dealt anyhow, over many packed rows with ties
    across them, give what plain counts give."""
    from tidewell.operators import products

    rng = np.random.default_rng(11)
    made, keep = [], retrieval.written
    for module in (retrieval, products):
        monkeypatch.setattr(module, "written", lambda df: made.append(keep(df)) or made[-1])
    rows = [(f"d{i % 3}/f{i:03d}", 1, " ".join(["tie"] + [f"w{x}" for x in rng.integers(0, 4000, 60)])) for i in range(120)]
    chunks = spark.createDataFrame(rows, "path string, start_line int, text string").repartition(9, "text")
    asks = {0: ["tie"], 1: ["tie", "w12"], 2: ["w7", "d1/f0", "e w"], 3: ["w3", "w39"]}
    got = corpus.lexical_retrieve(spark.createDataFrame(list(asks.items()), "query_id long, terms array<string>"), chunks, 4).collect()
    want = []
    for i, terms in asks.items():
        sums = {r[:2]: sum(3 * (t in r[0]) + min(5, r[2].count(t)) for t in terms) for r in rows}
        best = sorted((-round(n / max(sums.values()), 6), *key) for key, n in sums.items() if n)[:4]
        want += [(i, n + 1, *x) for n, x in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], -r["score"], r["path"], r["start_line"]) for r in got) == want
    assert max(df.count() for df in made) <= len(rows)


def test_terms_in_texts_are_counted_as_plain_search_counts_them():
    from tidewell.operators import products

    rng = np.random.default_rng(2)
    pieces = ["a", "ab", "aba", "abab", "été", "漢字", "_", "9", ".", "->", " ", "(", "b.a", "longer_name"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 40))) for _ in range(150)]
    terms = {t: i for i, t in enumerate(sorted({"".join(rng.choice(pieces, rng.integers(1, 4))) for _ in range(200)}))}
    found = products.Terms(terms)
    for text in texts * 2:
        assert found.counts(text) == {i: text.count(t) for t, i in terms.items() if t in text}


def test_the_runs_of_a_bucket_cost_no_more_calls_than_one():
    from pyspark.sql import Row

    from tidewell.streaming import jobs

    class Time:
        now = 0
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.now

    guard, calls = jobs._BudgetGuard(100, 0.8, 1.0, 1000), _Calls()
    calls.keys = lambda: iter(list(calls.entries))
    calls.removeKey = lambda k: calls.entries.pop(k)
    guard.init(calls)
    row = lambda run, m, total, pos: Row(run_id=run, message_id=m, total_tokens=total, pos=pos, at_ms=pos)
    first = [row(f"r{i}", "m", 50, i) for i in range(500)]
    assert {r.used for r in guard.handleInputRows((7,), iter(first), None)} == {50} and calls.n == 3 and calls.timers == [1000]
    many = [row("r400", f"m{i}", 1, 2000 + i) for i in range(guard.INLINE + 9)]
    assert list(guard.handleInputRows((7,), iter(many), None))[-1].used == 50 + len(many) and len(calls.entries) == 10
    # what the watermark has passed goes at once, the run with newer events stays with its messages
    Time.now = 1600
    list(guard.handleExpiredTimer((7,), Time(), Time()))
    assert len(calls.entries) == 10 and calls.timers[-1] > 1600 and set(guard._held()[1]) == {"r400"}
    assert [r.used for r in guard.handleInputRows((7,), iter([row("r400", f"m{guard.INLINE + 8}", 3, 3000), row("r1", "m", 5, 3001)]), None)] == [50 + len(many) + 2, 5]
    Time.now = 4000
    list(guard.handleExpiredTimer((7,), Time(), Time()))
    assert not calls.entries and set(guard._held()[1]) == {"r1"}
    Time.now = 4001
    list(guard.handleExpiredTimer((7,), Time(), Time()))
    assert calls.value is None
