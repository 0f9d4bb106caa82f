"""Event logs: shell lines, Python texts and log lines of either layout by hand and by brute force."""

import json
import shlex

import pytest
from pyspark.sql import functions as F

from runweave.operators import logs


@pytest.mark.parametrize(("line", "programs"), [
    ("ls -l", ["ls"]),
    ("cd a && ls; pwd || true | wc", ["cd", "ls", "pwd", "true", "wc"]),
    ("echo 'a; b | c' \"d && e\" f\\;g", ["echo"]),
    ("echo $(ls | wc; echo x) | sort", ["echo", "ls", "wc", "echo", "sort"]),
    ("A=1 B='x y' sudo /usr/bin/python3 x.py 2>&1 &", ["python3"]),
    ("cat > x <<'EOF'\nls; rm y\nEOF\nls", ["cat", "ls"]),
    ("", []), (None, []), (" ;; ", []),
])
def test_shell_lines(line, programs):
    assert [c["name"] for c in logs._commands(line)] == programs


def test_shell_lines_against_a_lexer():
    words = ["ls", "-l", "'a b'", '"c;d"', "'e|f'"]
    for n in range(200):
        own = [words[(n * 7 + k * k) % 5] for k in range(1 + n % 6)]
        cuts = [[";", "&&", "||", "|"][(n + k) % 4] for k in range(len(own) - 1)]
        line = " ".join(x for pair in zip(own, [*cuts, ""], strict=True) for x in pair).strip()
        lexer = shlex.shlex(line, posix=False, punctuation_chars=True)
        lexer.whitespace_split = True
        parts, held = [], []
        for token in lexer:
            if set(token) <= set(";&|"):
                parts.append(held)
                held = []
            else:
                held.append(token)
        assert [c["words"] for c in logs._commands(line)] == [[w.strip("'\"") for w in p] for p in [*parts, held] if p]


@pytest.mark.parametrize(("line", "kind"), [("cat a b > c", "concat"), ("cat a | wc", "pipe"), ("cat <<E > x\nhi\nE", "heredoc_write"), ("cat a", "other"), ("cat a || true", "other"), ("ls", None), (None, None)])
def test_cat_classes(line, kind):
    assert logs.cat_class(line) == kind


def test_library_calls():
    code = "import numpy as np, os\nimport a.b.c as d\nfrom x.y import f as g, h\nnp.fft.fft(np.array([1]))\nnp.array(2)\nos.path.join()\nd.e()\ng()\nh.i()\nlen([])\nself.np()\n"
    assert logs.library_calls(code) == {"numpy.fft.fft": 1, "numpy.array": 2, "os.path.join": 1, "a.b.c.e": 1, "x.y.f": 1, "x.y.h.i": 1}
    assert logs.library_calls("def (") == logs.library_calls(None) == {}


def test_lines_put_together(spark):
    whole = [{"a": "x{", "b": [1, {"c": "\\\" }"}]}, {"d": 2}, {"e": "t"}]
    lines = json.dumps(whole[0], indent=1).split("\n") + [json.dumps(whole[1]), "", '{"e":', '"t"}']
    df = spark.createDataFrame([("s", k, line) for k, line in enumerate(lines)], "session string, pos int, line string")
    got = [json.loads(r.line) for r in logs.whole_lines(df).orderBy("pos").collect()]
    assert got == whole


def item(at, **payload):
    return json.dumps({"type": "response_item", "timestamp": f"2024-01-01T00:00:{at:02d}Z", "payload": payload})


def test_item_log(spark):
    lines = [
        item(0, type="message", role="system", content="rules"),
        item(1, type="message", role="user", content=[{"type": "input_text", "text": "first"}]),
        item(2, type="message", role="user", content=[{"text": "do"}, {"text": "it"}]),
        item(4, type="function_call", call_id="c1", name="shell", arguments=json.dumps({"command": "ls | wc"})),
        item(5, type="function_call_output", call_id="c1", output="3"),
        item(6, type="function_call_output", call_id="other", output="lost"),
        item(7, type="custom_tool_call", call_id="c2", name="patch", input="text"),
        item(8, type="message", role="assistant", content="done"),
        item(9, type="message", role="assistant", content=""),
        "no json", json.dumps({"type": "event_msg", "payload": {"type": "token_count"}}), "[1]",
    ]
    df = spark.createDataFrame([("s", k, line) for k, line in enumerate(lines)], "session string, pos int, line string")
    steps = logs.finalised(logs.with_outputs(logs.item_steps(df)))
    got = [(r.step, r.source, r.kind, r.message, r.tool, r.outputs, r.seconds) for r in steps.orderBy("step").collect()]
    assert got == [
        (1, "USER", "message", "do\nit", None, [], None),
        (2, "AGENT", "call", "", "shell", ["3"], 2.0),
        (3, "AGENT", "call", "", "patch", [], 3.0),
        (4, "AGENT", "message", "done", None, [], 1.0),
    ]
    row = logs.payload(steps, F.get_json_object("arguments", "$.command")).first()
    assert (row.steps, row.users, row.calls, row.answered, row.seconds, row.tools, row.programs) == (4, 1, 2, 1, 6.0, {"shell": 1, "patch": 1}, {"ls": 1, "wc": 1})
    light = logs.light(steps).first().steps
    assert [s.call.tool if s.call else None for s in light] == [None, "shell", "patch", None]


def test_message_log(spark):
    def message(kind, content):
        return json.dumps({"type": kind, "message": {"role": kind, "content": content}})

    lines = [
        message("user", "go"),
        message("assistant", [{"type": "text", "text": "I'll look"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "cat a b"}}]),
        message("user", [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "A"}, {"type": "text", "text": "B"}]}]),
        json.dumps({"type": "summary"}),
    ]
    df = spark.createDataFrame([("s", k, line) for k, line in enumerate(lines)], "session string, pos int, line string")
    got = [(r.pos, r.sub, r.source, r.kind, r.message, r.outputs) for r in logs.with_outputs(logs.message_steps(df)).orderBy("pos", "sub").collect()]
    assert got == [(0, 0, "USER", "message", "go", []), (1, 0, "AGENT", "message", "I'll look", []), (1, 1, "AGENT", "call", "cat a b", ["A\nB"])]


def test_a_step_before_the_one_before_it_is_an_error(spark):
    df = spark.createDataFrame([("s", 0, item(5, type="message", role="user", content="a")), ("s", 1, item(4, type="message", role="assistant", content="b"))], "session string, pos int, line string")
    with pytest.raises(Exception, match="before"):
        logs.finalised(logs.item_steps(df)).collect()


def test_chat_log(spark):
    doc = {"messages": [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "content": "go"},
        {"type": "info", "content": "skip"},
        {"type": "gemini", "timestamp": "2024-01-01T00:00:02Z", "content": [{"text": "a"}, {"text": "b"}], "thoughts": [{"subject": "S", "description": "d"}, {"description": "e"}, {"subject": "no text"}],
         "toolCalls": [{"id": "x", "name": "sh", "args": {"command": "ls", "cwd": "/t"}, "timestamp": "2024-01-01T00:00:03Z", "result": [{"functionResponse": {"response": {"error": "e"}}}, {"functionResponse": {"response": {"output": "o"}}}]}, {"args": {"k": 1}}]},
    ]}
    df = spark.createDataFrame([("s", json.dumps(doc)), ("t", "no json"), ("u", None), ("v", "{}")], "session string, doc string")
    got = [(r.pos, r.source, r.kind, r.message, r.call_id, r.tool, r.arguments, r.outputs, r.timestamp[-3:]) for r in logs.with_outputs(logs.chat_steps(df)).orderBy("pos", "sub").collect()]
    assert got == [
        (0, "USER", "message", "go", None, None, None, [], "00Z"),
        (2, "AGENT", "reasoning", "S: d\ne", None, None, None, [], "02Z"),
        (2, "AGENT", "message", "a\nb", None, None, None, [], "02Z"),
        (2, "AGENT", "call", "(cwd: /t) ls", "x", "sh", '{"command":"ls","cwd":"/t"}', ["o"], "03Z"),
        (2, "AGENT", "call", "tool", "call-2-2", "tool", '{"k":1}', [], "02Z"),
    ]


PARTS = [
    ("p2", {"type": "tool", "tool": "bash", "callID": "c", "state": {"input": {"command": "ls"}, "error": "bad", "time": {"start": 3000, "end": 4000}}}),
    ("p1", {"type": "text", "text": "hello", "time": {"start": 2000}}),
    ("p0", {"type": "step-start"}),
    ("p3", {"type": "reasoning", "summary": "hm"}),
]
PART_STEPS = [("AGENT", "message", "hello", None, [], "1970-01-01T00:00:02.000Z"), ("AGENT", "call", "ls", "c", ["bad"], "1970-01-01T00:00:03.000Z"), ("AGENT", "reasoning", "hm", None, [], "1970-01-01T00:00:01.000Z")]


def of_parts(steps):
    return [(r.source, r.kind, r.message, r.call_id, r.outputs, r.timestamp) for r in logs.with_outputs(steps).orderBy("pos", "sub").collect()]


def test_logs_of_parts(spark):
    user = {"role": "user", "time": {"created": 0}}
    agent = {"id": "m", "role": "assistant", "time": {"created": 1000}}
    in_order = [dict(PARTS)[k] for k in ("p0", "p1", "p2", "p3")]
    doc = {"info": {"id": "s"}, "messages": [{"info": agent, "parts": in_order}, {"info": user, "parts": [{"type": "text", "text": "go"}]}]}
    first = ("USER", "message", "go", None, [], "1970-01-01T00:00:00.000Z")
    assert of_parts(logs.document_steps(spark.createDataFrame([("s", json.dumps(doc))], "session string, doc string"))) == [first, *PART_STEPS]
    messages = spark.createDataFrame([("s", json.dumps(agent)), ("s", json.dumps({"id": "u"} | user))], "session string, text string")
    parts = spark.createDataFrame([("m", k, json.dumps(p)) for k, p in PARTS] + [("u", "q", json.dumps({"type": "text", "text": "go"})), ("u", "r", "broken")], "message_id string, name string, text string")
    assert of_parts(logs.folder_steps(messages, parts)) == [first, *PART_STEPS]


def test_episodes(spark):
    def episode(k, given, said):
        return ("s", k, json.dumps({"api_call_start_time": f"t{k}", "input": [{"role": r, "content": c} for r, c in given], "original_response": json.dumps({"choices": [{"message": {"content": said}}]})}))

    said = ['<think>why</think> Sure {"commands": [{"keystrokes": "ls\\n", "duration": 1}, {"keystrokes": "pwd"}]}', "<response><commands><keystrokes duration='2'>make</keystrokes></commands></response>", '{"commands": [], "task_complete": true}']
    given = [[("system", "rules"), ("user", "do it. Current terminal state:\n$")]]
    for k, out in ((0, "New Terminal Output:\na b\n"), (1, "well done")):
        given.append([*given[k], ("assistant", said[k]), ("user", out)])
    df = spark.createDataFrame([episode(k, given[k], said[k]) for k in (2, 0, 1)], "session string, episode int, doc string")
    got = [(r.pos, r.source, r.kind, r.message.strip(), r.call_id, r.outputs) for r in logs.with_outputs(logs.episode_steps(df)).orderBy("pos", "sub").collect()]
    assert got == [
        (0, "SYSTEM", "message", "rules", None, []),
        (0, "USER", "message", "do it. Current terminal state:\n$", None, []),
        (0, "AGENT", "reasoning", "why", None, []),
        (0, "AGENT", "message", said[0].split("</think>")[1].strip(), None, []),
        (0, "AGENT", "call", "ls", "call_0_1", []),
        (0, "AGENT", "call", "pwd", "call_0_2", ["a b"]),
        (1, "USER", "message", "New Terminal Output:\na b", None, []),
        (1, "AGENT", "message", said[1], None, []),
        (1, "AGENT", "call", "make", "call_1_1", []),
        (2, "USER", "message", "well done", None, []),
        (2, "AGENT", "message", said[2], None, []),
        (2, "AGENT", "call", "mark_task_complete", "call_2_task_complete", []),
    ]


def test_scripts_have_the_code_that_was_written_last(spark):
    commands = [
        ("python a.py", None, None, "x\ny"),
        ("cat > a.py <<E\nimport os\nos.getcwd()\nE\npython3 ./a.py && python3 -m pip install x", None, None, "Traceback (most recent call last)"),
        (None, "b.py", "import json\njson.loads('1')\n", None),
        ("x=$(python -u b.py) ; python - <<'E'\n1\nE\npython -c 'print(2)'; python < in", None, None, ""),
        ("tee a.py <<E\n3\nE", None, None, None),
        ("python a.py", None, None, None),
    ]
    rows = [("s", k, 0, "call", f"c{k}", [out] if out is not None else [], c, f, t) for k, (c, f, t, out) in enumerate(commands)]
    rows += [("other", 9, 0, "call", "c9", [], "python a.py", None, None)]
    df = spark.createDataFrame(rows, "session string, pos int, sub int, kind string, call_id string, outputs array<string>, command string, file string, content string")
    runs = logs.script_runs(df, F.col("command"), F.col("file"), F.col("content")).orderBy("session", "pos", "n").collect()
    assert [(r.call_id, r.mode, r.path, r.code_lines, r.libraries, r.output_lines, r.failed) for r in runs] == [
        ("c9", "script", "a.py", None, {}, 0, False),
        ("c0", "script", "a.py", None, {}, 2, False),
        ("c1", "script", "a.py", 2, {"os.getcwd": 1}, 1, True),
        ("c1", "module", "pip", None, {}, 1, True),
        ("c3", "script", "b.py", 2, {"json.loads": 1}, 0, False),
        ("c3", "heredoc", None, 1, {}, 0, False),
        ("c3", "code", None, 1, {}, 0, False),
        ("c3", "other", None, None, {}, 0, False),
        ("c5", "script", "a.py", 1, {}, 0, False),
    ]
    assert [(r.path, r.calls) for r in logs.file_counts(df.withColumn("tool", F.lit("t")), F.col("file")).collect()] == [("b.py", 1)]


def test_lines_of_script_runs_are_parsed_once(spark):
    df = spark.createDataFrame([("s", 0, 0, "call", "c", [], "python a.py")], "session string, pos int, sub int, kind string, call_id string, outputs array<string>, command string")
    plan = logs.script_runs(df, F.col("command"))._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython [commands_of" in line for line in plan.splitlines()) == 1


def test_codes_without_imports_are_not_parsed(monkeypatch):
    logs.library_calls.cache_clear()
    parsed = []
    monkeypatch.setattr(logs.ast, "parse", lambda code, parse=logs.ast.parse: parsed.append(code) or parse(code))
    assert logs.library_calls("print(len('x'))\n" * 50) == {} and not parsed
    assert [logs.library_calls("import os\nos.getcwd()") for _ in range(3)] == [{"os.getcwd": 1}] * 3 and len(parsed) == 1
