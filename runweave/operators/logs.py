"""Event logs of agents: logs of six layouts become steps of one shape, and steps become counts, costs and payloads.

Six layouts are read. Of logs that are tables of lines (session, pos, line), `item_steps` reads lines that each hold
one item with a payload (messages, calls and their outputs apart), `message_steps` lines that each hold a message of
blocks. `chat_steps` reads a session that is one document (session, doc) of messages with calls and results inside,
`document_steps` one of messages with parts, `folder_steps` messages and parts that are files each, `episode_steps`
one document for each request of a terminal session, which repeats all messages before it.

Steps have session, pos, sub (the block's place), timestamp, source, kind (message, reasoning, call, output), message,
call_id, tool, arguments and output. Lines and documents that are no JSON objects are left out.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shell

STEP = ["session", "pos", "sub", "timestamp", "source", "kind", "message", "call_id", "tool", "arguments", "output"]


def whole_lines(lines: DataFrame) -> DataFrame:
    """(session, pos, line) with physical lines put together that are one JSON text: each text begins where a line begins with a brace and the text before it is whole.

    Control characters inside texts become blanks.
    """
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("line", T.StringType())])))
    def put(own: pd.Series) -> pd.Series:
        return pd.Series([assembled([(r["pos"], r["line"]) for r in rows]) for rows in own])

    rows = lines.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "line"))).alias("own"))
    return rows.select("session", F.inline(put("own")))


def assembled(rows: list[tuple[int, str]]) -> list[dict]:
    """Texts whose braces and brackets outside strings are even, from physical lines."""
    out: list[dict] = []
    held, start, depth, quoted, escaped = [], 0, 0, False, False
    for pos, line in rows:
        text = "".join(" " if ord(c) < 32 else c for c in line or "")
        if not held and not text.strip():
            continue
        start = pos if not held else start
        held.append(text)
        for c in text:
            if quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                quoted = True
            else:
                depth += (c in "{[") - (c in "}]")
        if depth <= 0 and not quoted:
            out.append({"pos": start, "line": " ".join(held)})
            held, depth = [], 0
    return out


def source_of(role: Column) -> Column:
    role = F.lower(F.trim(role))
    return F.when(role.isin("assistant", "agent", "model"), "AGENT").when(role == "user", "USER").otherwise("SYSTEM")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(content: Column) -> Column:
    """The text of a content that is a text, or blocks with texts, of which each is a line."""
    blocks = _get(content, "$", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.coalesce(_get(b, "$.text"), _get(b, "$"))), lambda t: t.isNotNull() & (t != ""))
    return F.when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(_get(content, "$"))


def item_steps(lines: DataFrame) -> DataFrame:
    """Steps of lines {"type": "response_item", "timestamp", "payload": {"type": message | function_call | custom_tool_call | ..._output, ...}}."""
    rows = lines.withColumn("v", F.try_parse_json("line")).withColumn("p", _get(F.col("v"), "$.payload", "variant"))
    kind = _get(F.col("p"), "$.type")
    p = F.col("p")
    rows = rows.where(_get(F.col("v"), "$.type") == "response_item").withColumns({
        "kind": F.when(kind == "message", "message").when(kind.isin("function_call", "custom_tool_call"), "call").when(kind.isin("function_call_output", "custom_tool_call_output"), "output"),
        "sub": F.lit(0),
        "timestamp": _get(F.col("v"), "$.timestamp"),
        "source": F.when(kind == "message", source_of(_get(p, "$.role"))).otherwise("AGENT"),
        "message": F.when(kind == "message", text_of(_get(p, "$.content", "variant"))).otherwise(""),
        "call_id": F.nullif(F.trim(_get(p, "$.call_id")), F.lit("")),
        "tool": F.nullif(F.trim(_get(p, "$.name")), F.lit("")),
        "arguments": F.coalesce(_get(p, "$.arguments"), F.to_json(F.struct(_get(p, "$.input").alias("input")))),
        "output": F.coalesce(_get(p, "$.output.content"), _get(p, "$.output")),
    })
    good = F.when(F.col("kind") == "message", F.col("message") != "").when(F.col("kind") == "call", F.col("call_id").isNotNull() & F.col("tool").isNotNull()).otherwise(F.col("call_id").isNotNull())
    return rows.where(F.col("kind").isNotNull() & F.coalesce(good, F.lit(False))).select(*STEP)


def message_steps(lines: DataFrame) -> DataFrame:
    """Steps of lines {"type": assistant | user, "timestamp", "message": {"role", "content": text or blocks of type text, tool_use, tool_result}}."""
    rows = lines.withColumn("v", F.try_parse_json("line")).where(_get(F.col("v"), "$.type").isin("assistant", "user"))
    content = _get(F.col("v"), "$.message.content", "variant")
    blocks = F.coalesce(_get(content, "$", "array<variant>"), F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), _get(content, "$").alias("text"))))))
    rows = rows.select("session", "pos", "v", F.posexplode(blocks).alias("sub", "b"))
    b, kind = F.col("b"), _get(F.col("b"), "$.type")
    role = F.coalesce(_get(F.col("v"), "$.message.role"), _get(F.col("v"), "$.type"))
    rows = rows.withColumns({
        "kind": F.when(kind == "text", "message").when(kind == "tool_use", "call").when(kind == "tool_result", "output"),
        "timestamp": _get(F.col("v"), "$.timestamp"),
        "source": F.when(kind == "text", source_of(role)).otherwise("AGENT"),
        "message": F.when(kind == "text", _get(b, "$.text")).when(kind == "tool_use", F.coalesce(_get(b, "$.input.command"), _get(b, "$.name"), F.lit("tool"))).otherwise("Tool output"),
        "call_id": F.coalesce(_get(b, "$.tool_use_id"), F.nullif(_get(b, "$.id"), F.lit("")), F.concat(F.lit("call-"), F.col("pos").cast("string"), F.lit("-"), F.col("sub").cast("string"))),
        "tool": F.when(kind == "tool_use", F.coalesce(F.nullif(_get(b, "$.name"), F.lit("")), F.lit("tool"))),
        "arguments": F.to_json(_get(b, "$.input", "variant")),
        "output": F.when(kind == "tool_result", F.coalesce(text_of(_get(b, "$.content", "variant")), F.lit(""))),
    })
    return rows.where(F.col("kind").isNotNull() & (F.coalesce("message", F.lit("")) != "")).select(*STEP)


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    """Steps from structs of (sub, timestamp, source, kind, message, call_id, tool, arguments, output), null where there is none."""
    found = F.filter(F.flatten(F.array(*rows)), lambda r: r.isNotNull())
    return df.select("session", "pos", F.inline(found)).select(*STEP)


def _step(sub: Column, timestamp: Column, source: Column | str, kind: str, message: Column | None = None, call_id: Column | None = None, tool: Column | None = None, arguments: Column | None = None, output: Column | None = None) -> Column:
    values = {"message": message, "call_id": call_id, "tool": tool, "arguments": arguments, "output": output}
    text = [(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in values.items()]
    return F.struct(sub.cast("int").alias("sub"), timestamp.cast("string").alias("timestamp"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(kind).alias("kind"), *text)


def _named(text: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), otherwise)


def label_of(arguments: Column, tool: Column) -> Column:
    """What a call says of itself: its command, with the folder it runs in, or else its tool."""
    command = F.coalesce(_get(arguments, "$.command"), _get(arguments, "$.cmd"))
    folder = F.nullif(F.coalesce(_get(arguments, "$.workdir"), _get(arguments, "$.cwd")), F.lit(""))
    return F.coalesce(F.when(folder.isNull(), command).otherwise(F.concat(F.lit("(cwd: "), folder, F.lit(") "), command)), tool)


def output_of(value: Column) -> Column:
    """The text of an output: a text, the `output` of an object, or JSON."""
    return F.coalesce(_get(value, "$.output"), _get(value, "$"), F.to_json(value))


def chat_steps(docs: DataFrame) -> DataFrame:
    """Steps of documents {"messages": [{"type": user | gemini, "timestamp", "content", "thoughts": [{"subject", "description"}], "toolCalls": [{"id", "name", "args", "timestamp", "result": [{"functionResponse": {"response": {"output"}}}]}]}]}."""
    messages = _get(F.try_parse_json("doc"), "$.messages", "array<variant>")
    rows = docs.select("session", F.posexplode(messages).alias("pos", "m"))
    m, kind = F.col("m"), _get(F.col("m"), "$.type")
    rows = rows.where(kind.isin("user", "gemini"))
    time, said = _get(m, "$.timestamp"), F.coalesce(text_of(_get(m, "$.content", "variant")), F.lit(""))
    thoughts = F.transform(F.coalesce(_get(m, "$.thoughts", "array<variant>"), F.array()), lambda t: F.array_join(F.filter(F.array(F.when(F.trim(_get(t, "$.description")) != "", F.nullif(F.trim(_get(t, "$.subject")), F.lit(""))), F.nullif(F.trim(_get(t, "$.description")), F.lit(""))), lambda x: x.isNotNull()), ": "))
    thought = F.array_join(F.filter(thoughts, lambda t: t != ""), "\n")
    calls = F.filter(F.coalesce(_get(m, "$.toolCalls", "array<variant>"), F.array()), lambda c: _get(c, "$", "map<string,variant>").isNotNull())

    def call_id(c: Column, i: Column) -> Column:
        return _named(_get(c, "$.id"), F.concat(F.lit("call-"), F.col("pos").cast("string"), F.lit("-"), (i + 1).cast("string")))

    def call(c: Column, i: Column) -> Column:
        tool = _named(_get(c, "$.name"), F.lit("tool"))
        return _step(2 * i + 2, F.coalesce(_get(c, "$.timestamp"), time), "AGENT", "call", label_of(_get(c, "$.args", "variant"), tool), call_id(c, i), tool, F.coalesce(F.to_json(_get(c, "$.args", "variant")), F.lit("{}")))

    def result(c: Column, i: Column) -> Column:
        outputs = F.transform(F.coalesce(_get(c, "$.result", "array<variant>"), F.array()), lambda r: output_of(_get(r, "$.functionResponse.response.output", "variant")))
        return _step(2 * i + 3, F.coalesce(_get(c, "$.timestamp"), time), "AGENT", "output", F.lit("Tool output"), call_id(c, i), output=F.get(F.filter(outputs, lambda o: o.isNotNull()), F.lit(0)))

    own = F.array(F.when((kind == "gemini") & (thought != ""), _step(F.lit(0), time, "AGENT", "reasoning", thought)), F.when(said != "", _step(F.lit(1), time, source_of(F.when(kind == "user", "user").otherwise("model")), "message", said)))
    return _rows(rows, own, F.transform(calls, call), F.filter(F.transform(calls, result), lambda r: r["output"].isNotNull()))


def _part_steps(parts: DataFrame) -> DataFrame:
    """Steps of parts (session, created, message, role, place, part): texts, reasoning, and calls whose state holds input and output. Messages go by the time they were made; other kinds of parts are left out."""
    p, kind = F.col("part"), _get(F.col("part"), "$.type")
    began = F.coalesce(_get(p, "$.time.start", "long"), _get(p, "$.state.time.start", "long"))
    ended = F.coalesce(*(_get(p, f"$.{at}.{name}", "long") for at in ("state.time", "time") for name in ("end", "completed", "finish", "finished", "updated")), began)
    iso = lambda ms: F.date_format(F.timestamp_millis(F.coalesce(ms, F.col("created"))), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows = parts.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("created", "message", "place")).cast("long"))
    source = source_of(F.col("role"))
    text = F.coalesce(*(text_of(_get(p, f"$.{c}", "variant")) for c in ("text", "content", "summary")), F.lit(""))
    tool, call_id = _get(p, "$.tool"), _named(_get(p, "$.callID"), F.concat(F.lit("call-"), F.col("pos").cast("string")))
    given = _get(p, "$.state.input", "variant")
    output = F.coalesce(*(output_of(_get(p, f"$.state.{c}", "variant")) for c in ("output", "error", "metadata.output")))
    return _rows(
        rows,
        F.array(
            F.when((kind == "text") & (text != ""), _step(F.lit(0), iso(began), source, "message", text)),
            F.when((kind == "reasoning") & (text != ""), _step(F.lit(0), iso(began), source, "reasoning", text)),
            F.when(kind == "tool", _step(F.lit(0), iso(began), "AGENT", "call", label_of(given, tool), call_id, tool, F.coalesce(F.to_json(given), F.lit("{}")))),
            F.when((kind == "tool") & output.isNotNull(), _step(F.lit(1), iso(ended), "AGENT", "output", F.lit("Tool output"), call_id, output=output)),
        ),
    )


def document_steps(docs: DataFrame) -> DataFrame:
    """Steps of documents {"messages": [{"info": {"role", "time": {"created"}}, "parts": [part, ...]}]}; parts in the document's order."""
    messages = _get(F.try_parse_json("doc"), "$.messages", "array<variant>")
    rows = docs.select("session", F.posexplode(messages).alias("at", "m"))
    rows = rows.select("session", _get(F.col("m"), "$.info.time.created", "long").alias("created"), F.lpad(F.col("at").cast("string"), 10, "0").alias("message"), _get(F.col("m"), "$.info.role").alias("role"), F.posexplode(_get(F.col("m"), "$.parts", "array<variant>")).alias("place", "part"))
    return _part_steps(rows)


def folder_steps(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Steps of a folder's messages (session, text: {"id", "role", "time": {"created"}}) and their parts (message_id, name, text). Parts go by the time they began (those without last), then by name."""
    m = F.try_parse_json("text")
    own = messages.select("session", _get(m, "$.id").alias("message"), _get(m, "$.role").alias("role"), _get(m, "$.time.created", "long").alias("created"))
    each = parts.select(F.col("message_id").alias("message"), "name", m.alias("part")).where(F.col("part").isNotNull())
    began = F.coalesce(_get(F.col("part"), "$.time.start", "long"), _get(F.col("part"), "$.state.time.start", "long"))
    return _part_steps(own.join(each, "message").withColumn("place", F.struct(began.isNull().alias("none"), began.alias("began"), "name")))


#: What stands before the terminal's text in a message. Fixed values.
TERMINAL = r"(?s)(?:New Terminal Output:\n|Current terminal state:\n)\s*(.*?)\s*$"


def episode_steps(docs: DataFrame) -> DataFrame:
    """Steps of a session's requests (session, episode, doc: {"api_call_start_time", "input": [{"role", "content"}], "original_response": JSON with choices}).

    A request repeats the messages before it, the answer among them, so only what lies behind those is new. A user's
    message that shows the terminal is the output of the last call of the request before. Answers hold a think block
    and commands, as JSON or in a response element; without commands they are messages alone.
    """
    rows = docs.withColumn("d", F.try_parse_json("doc")).where(F.col("d").isNotNull())
    given = F.coalesce(_get(F.col("d"), "$.input", "array<variant>"), F.array())
    order = Window.partitionBy("session").orderBy("episode")
    answer = F.try_parse_json(_get(F.col("d"), "$.original_response"))
    said = F.coalesce(_get(answer, "$.choices[0].message.content"), _get(answer, "$.choices[0].message.reasoning_content"), F.lit(""))
    plain = F.try_parse_json(F.regexp_extract(said, r"(?s)\{.*\}", 0))
    element = F.transform(F.regexp_extract_all(said, F.lit(r"(?s)<keystrokes[^>]*>(.*?)</keystrokes>"), 1), lambda k: F.to_json(F.struct(k.alias("keystrokes"))))
    listed = F.transform(F.coalesce(_get(plain, "$.commands", "array<variant>"), F.array()), lambda c: F.to_json(c))
    done = F.coalesce(_get(plain, "$.task_complete", "boolean"), F.lit(False)) | said.rlike(r"(?s)<task_complete>\s*true")
    commands = F.when(said.contains("<response>"), element).otherwise(listed)
    rows = rows.select("session", F.col("episode").cast("long").alias("pos"), F.coalesce(_get(F.col("d"), "$.api_call_start_time"), _get(F.col("d"), "$.api_call_end_time")).alias("time"), given.alias("given"), said.alias("said"), commands.alias("commands"), done.alias("done"), "episode")
    rows = rows.withColumns({"seen": F.coalesce(F.lag(F.size("given")).over(order) + 1, F.lit(0)), "last": F.lag(F.size("commands")).over(order), "before": F.lag("pos").over(order)})
    time, n = F.col("time"), F.size("given")
    new = F.filter(F.transform("given", lambda m, i: F.struct(i.alias("i"), F.lower(_get(m, "$.role")).alias("role"), F.coalesce(text_of(_get(m, "$.content", "variant")), F.lit("")).alias("text"))), lambda m: m["i"] >= F.col("seen"))
    shown = lambda m: F.regexp_extract(m["text"], TERMINAL, 1)
    messages = F.transform(F.filter(new, lambda m: m["text"] != ""), lambda m: _step(2 * m["i"], time, source_of(m["role"]), "message", m["text"]))
    of = F.concat(F.lit("call_"), F.col("before").cast("string"), F.lit("_"), F.col("last").cast("string"))
    outputs = F.transform(F.filter(new, lambda m: (m["role"] == "user") & (F.col("last") > 0) & (shown(m) != "")), lambda m: _step(2 * m["i"] + 1, time, "AGENT", "output", F.lit("Tool output"), of, output=shown(m)))
    think = F.nullif(F.regexp_extract("said", r"(?s)<think>\s*(.*?)\s*</think>", 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace("said", r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")
    own = F.array(F.when(think.isNotNull(), _step(2 * n, time, "AGENT", "reasoning", think)), F.when(rest != "", _step(2 * n + 1, time, "AGENT", "message", rest)))
    calls = F.transform("commands", lambda c, i: _step(2 * n + 2 + i, time, "AGENT", "call", _get(F.parse_json(c), "$.keystrokes"), F.concat(F.lit("call_"), F.col("pos").cast("string"), F.lit("_"), (i + 1).cast("string")), F.lit("bash_command"), c))
    end = F.array(F.when(F.col("done"), _step(2 * n + 2 + F.size("commands"), time, "AGENT", "call", F.lit("mark_task_complete"), F.concat(F.lit("call_"), F.col("pos").cast("string"), F.lit("_task_complete")), F.lit("mark_task_complete"), F.lit("{}"))))
    return _rows(rows, messages, outputs, own, calls, end)


def with_outputs(steps: DataFrame) -> DataFrame:
    """Messages and calls, each call with the texts of its outputs in order; of several calls of one id the last has them, outputs of no call are left out."""
    at = F.struct("pos", "sub")
    own = Window.partitionBy("session", "call_id", F.when(F.col("call_id").isNull(), at))
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == "output", F.struct("pos", "sub", "output"))).over(own))["output"]
    last = F.max(F.when(F.col("kind") == "call", at)).over(own)
    outputs = F.when((F.col("kind") == "call") & (at == last), texts).otherwise(F.array().cast("array<string>"))
    return steps.withColumn("outputs", outputs).where("kind <> 'output'").drop("output")


def finalised(steps: DataFrame) -> DataFrame:
    """Steps from the last one of the user on (all but leading SYSTEM steps where there is none), numbered from 1, AGENT steps with their seconds since the step before; a negative time is an error."""
    own = Window.partitionBy("session")
    order = own.orderBy("pos", "sub")
    at = F.struct("pos", "sub")
    begin = F.coalesce(F.max(F.when(F.col("source") == "USER", at)).over(own), F.min(F.when(F.col("source") != "SYSTEM", at)).over(own))
    kept = steps.withColumn("begin", begin).where(at >= F.col("begin")).drop("begin")
    time = F.unix_micros(F.to_timestamp("timestamp"))
    seconds = (time - F.lag(time).over(order)) / 1e6
    checked = F.when(seconds < 0, F.raise_error(F.lit("a step lies before the one before it")).cast("double")).otherwise(seconds)
    return kept.withColumn("step", F.row_number().over(order)).withColumn("seconds", F.when(F.col("source") == "AGENT", checked))


def cat_class(line: str | None) -> str | None:
    """What a line uses cat for: heredoc_write, concat, pipe or other; NULL if for nothing. The first use that is more than other counts."""
    found = None
    for command in shell.commands(line):
        if command.name != "cat":
            continue
        files = [w for w in command.texts[1:] if not w.startswith("-")]
        kind = "heredoc_write" if command.heredoc is not None and command.target else "concat" if len(files) > 1 else "pipe" if command.writes and command.heredoc is None else "other"
        if kind != "other":
            return kind
        found = "other"
    return found


@lru_cache(maxsize=4_096)
def library_calls(code: str | None) -> dict[str, int]:
    """How often a Python text calls functions of what it imports, by full name; {} if it doesn't parse."""
    if not code or "import" not in code:  # nothing is imported
        return {}
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return {}
    names: dict[str, str] = {}
    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.Import):
            names |= {(a.asname or a.name.split(".")[0]): (a.name if a.asname else a.name.split(".")[0]) for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            names |= {(a.asname or a.name): f"{node.module}.{a.name}" for a in node.names}
    counts: Counter[str] = Counter()
    for node in nodes:
        if isinstance(node, ast.Call):
            parts, f = [], node.func
            while isinstance(f, ast.Attribute):
                parts.append(f.attr)
                f = f.value
            if isinstance(f, ast.Name) and f.id in names:
                counts[".".join([names[f.id], *reversed(parts)])] += 1
    return dict(counts)


_PYTHON = re.compile(r"python[\d.]*|pypy[\d.]*")


def python_use(command: shell.Command) -> tuple[str | None, str | None, str | None]:
    """(mode, code, path) of a command that runs Python: code given with -c, a here-document, a script or module, else other."""
    if not _PYTHON.fullmatch(command.name):
        return None, None, None
    rest = command.texts[1:]
    while rest and rest[0].startswith("-") and rest[0] not in ("-c", "-m", "-"):
        rest = rest[2 if rest[0] in ("-W", "-X") else 1 :]
    if rest[:1] == ["-c"] and len(rest) > 1:
        return "code", rest[1], None
    if rest[:1] == ["-m"] and len(rest) > 1:
        return "module", None, rest[1]
    if (not rest or rest[0] == "-") and command.heredoc is not None:
        return "heredoc", command.heredoc, None
    return ("script", None, rest[0].removeprefix("./")) if rest and rest[0] != "-" else ("other", None, None)


def written_file(command: shell.Command) -> str | None:
    """The file that a here-document goes to."""
    if command.heredoc is None or command.name not in ("cat", "tee"):
        return None
    files = [w for w in command.texts[1:] if not w.startswith("-")] if command.name == "tee" else []
    path = command.target or next(iter(files), None)
    return path.removeprefix("./") if path else None


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


_COMMAND = T.StructType([_field("name", T.StringType()), _field("words", T.ArrayType(T.StringType())), _field("depth", T.IntegerType()), _field("target", T.StringType()), _field("mode", T.StringType()), _field("code", T.StringType()), _field("path", T.StringType()), _field("writes", T.StringType())])


@F.pandas_udf(T.ArrayType(_COMMAND))
def commands_of(lines: pd.Series) -> pd.Series:
    """All commands of each line, with what they run or write. A line that repeats is parsed once a worker."""
    return lines.map(_commands)


def _commands(line: str | None) -> list[dict]:
    out = []
    for c in shell.commands(line):
        mode, code, path = python_use(c)
        file = written_file(c)
        out.append({"name": c.name, "words": c.texts, "depth": c.depth, "target": c.target, "mode": mode, "code": c.heredoc if file else code, "path": path, "writes": file})
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def programs_of(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: [c.name for c in shell.commands(line)])


@F.pandas_udf(T.StringType())
def cat_class_of(lines: pd.Series) -> pd.Series:
    return lines.map(cat_class)


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def library_calls_of(codes: pd.Series) -> pd.Series:
    return codes.map(library_calls)


def tool_counts(calls: DataFrame) -> DataFrame:
    """(session, tool, calls, answered): calls of each tool, and those with an output."""
    return calls.where("kind = 'call'").groupBy("session", "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.size("outputs") > 0).alias("answered"))


def command_counts(calls: DataFrame, command: Column) -> DataFrame:
    """(session, program, uses, calls): how often the shell lines of calls use a program, and in how many calls."""
    each = calls.where("kind = 'call'").select("session", "pos", "sub", F.explode(programs_of(command)).alias("program"))
    return each.groupBy("session", "program").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("pos", "sub").alias("calls"))


def file_counts(calls: DataFrame, path: Column) -> DataFrame:
    """(session, tool, path, calls): how often each tool's calls name a file; path: where they do."""
    named = calls.where("kind = 'call'").select("session", "tool", F.nullif(F.trim(path), F.lit("")).alias("path")).where("path IS NOT NULL")
    return named.groupBy("session", "tool", "path").agg(F.count(F.lit(1)).alias("calls"))


def script_runs(calls: DataFrame, command: Column, file: Column | None = None, content: Column | None = None) -> DataFrame:
    """(session, pos, sub, call_id, n, mode, path, code, code_lines, libraries, output_lines, failed): each run of Python in the shell lines of calls.

    calls have outputs. n: the command's place in its line. A script's code is what was last written to its path in the
    session before: by a here-document, or by a call that names file and content; null if nothing was.
    output_lines and failed (a traceback shows) are of the call's outputs, whatever else it ran.
    """
    at = F.struct("pos", "sub", "n")
    own = calls.where("kind = 'call'")
    lines = lambda text: F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long")
    shown = F.array_join("outputs", "\n")
    each = own.select("session", "pos", "sub", "call_id", "outputs", F.posexplode(commands_of(command)).alias("n", "c")).where("c.writes IS NOT NULL OR c.mode IS NOT NULL")
    each = each.select("session", "pos", "sub", "call_id", "n", "c.mode", F.coalesce("c.writes", "c.path").alias("path"), "c.code", F.col("c.writes").isNotNull().alias("write"), lines(shown).alias("output_lines"), shown.contains("Traceback (most recent call last)").alias("failed"))
    if file is not None:
        by_call = own.select("session", "pos", "sub", "call_id", F.lit(-1).alias("n"), F.lit(None).cast("string").alias("mode"), F.regexp_replace(file, r"^\./", "").alias("path"), content.alias("code"), F.lit(True).alias("write"), F.lit(None).cast("long").alias("output_lines"), F.lit(None).cast("boolean").alias("failed"))
        each = each.unionByName(by_call.where("path IS NOT NULL AND code IS NOT NULL"))
    before = Window.partitionBy("session", "path").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    written = F.last(F.when(F.col("write"), F.col("code")), ignorenulls=True).over(before)
    # all runs pass the window, as scripts apart from the others would parse every line twice
    runs = each.withColumn("code", F.when(~F.col("write") & (F.col("mode") == "script"), written).otherwise(F.col("code"))).where("NOT write")
    return runs.select("session", "pos", "sub", "call_id", "n", "mode", "path", "code", F.when(F.col("code").isNotNull(), lines(F.col("code"))).alias("code_lines"), library_calls_of("code").alias("libraries"), "output_lines", "failed")


def inclusive_prompt(prompt: Column, cached: Column) -> Column:
    """Prompt tokens with those from the cache: some logs leave them out, which shows where the cache is larger."""
    return F.when(cached > prompt, prompt + cached).otherwise(prompt)


def token_averages(finals: DataFrame) -> DataFrame:
    """(session, prompt, completion, prompt_per_step, completion_per_step) of each session's final figures (session, steps, prompt, cached, completion); prompts with those from the cache. A session without steps is an error."""
    steps = F.when(F.col("steps") > 0, F.col("steps")).otherwise(F.raise_error(F.concat(F.lit("no steps: "), F.col("session").cast("string"))).cast("long"))
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    prompt = inclusive_prompt(n("prompt"), n("cached"))
    return finals.select("session", prompt.alias("prompt"), n("completion").alias("completion"), (prompt / steps).alias("prompt_per_step"), (n("completion") / steps).alias("completion_per_step"))


def cost(prompt: Column, cached: Column, completion: Column, price: Column, cached_price: Column, out_price: Column) -> Column:
    """Of tokens at prices for a million."""
    whole = inclusive_prompt(prompt, cached)
    return ((whole - cached) * price + cached * cached_price + completion * out_price) / 1e6


def token_faults(steps: DataFrame, finals: DataFrame, fields: list[str]) -> DataFrame:
    """(session, field, steps, final) where the tokens of a session's steps don't add up to its final figures."""
    sums = steps.groupBy("session").agg(*(F.sum(f).alias(f) for f in fields))
    both = finals.join(sums.withColumnsRenamed({f: f"of_steps_{f}" for f in fields}), "session", "left")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(f"of_steps_{f}", F.lit(0)).cast("long").alias("steps"), F.col(f).cast("long").alias("final")) for f in fields)))
    return both.select("session", each.alias("x")).select("session", "x.*").where("NOT steps <=> final")


def light(steps: DataFrame) -> DataFrame:
    """(session, steps): each log as an array of what a reader needs of its steps."""
    call = F.when(F.col("kind") == "call", F.struct("call_id", "tool", "arguments"))
    one = F.struct("step", "source", "message", call.alias("call"), "outputs")
    return steps.groupBy("session").agg(F.array_sort(F.collect_list(one), lambda a, b: a["step"] - b["step"]).alias("steps"))


def payload(steps: DataFrame, command: Column) -> DataFrame:
    """(session, steps, users, agents, calls, answered, seconds, tools, programs): all figures of each log in one row, from one reading of the steps."""
    call = F.col("kind") == "call"
    entry = lambda kind, name: F.struct(F.lit(kind).alias("of"), name.alias("name"))
    tools = F.when(call & F.col("tool").isNotNull(), F.array(entry("tool", F.col("tool"))))
    programs = F.when(call, F.transform(programs_of(command), lambda name: entry("program", name)))
    entries = F.flatten(F.filter(F.array(F.array(entry("step", F.lit(""))), tools, programs), lambda x: x.isNotNull()))
    flags = {"users": F.col("source") == "USER", "agents": F.col("source") == "AGENT", "calls": call, "answered": call & (F.size("outputs") > 0)}
    each = steps.select("session", "seconds", *(f.alias(k) for k, f in flags.items()), F.explode(entries).alias("e"))
    counts = each.groupBy("session", "e.of", "e.name").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), *(F.count_if(k).alias(k) for k in flags))
    step = lambda c: F.max(F.when(F.col("of") == "step", F.col(c)))
    by_name = lambda of: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == of, F.struct("name", "n")))))
    return counts.groupBy("session").agg(step("n").alias("steps"), *(step(k).alias(k) for k in flags), step("seconds").alias("seconds"), by_name("tool").alias("tools"), by_name("program").alias("programs"))
