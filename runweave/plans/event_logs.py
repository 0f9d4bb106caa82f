"""Queries over event logs: conversations and users' events are written as log lines and read back as steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import logs
from ..sources import tables
from .kernels import q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: The shell line of each kind of event, in which # is the event's number modulo 5, and its programs.
LINES = {
    "click": ("cd /data && cat a#.txt b.txt | wc -l", ["cd", "cat", "wc"]),
    "view": ("X=# python run#.py; echo 'a; b' || true", ["python", "echo", "true"]),
    "purchase": ('grep -n "x|#" $(ls | head -#) | sort | uniq -c', ["grep", "ls", "head", "sort", "uniq"]),
    "error": ("cat <<EOF > out#.txt\nls; rm x\nEOF\ncat out.txt", ["cat", "cat"]),
    "signup": ('for f in $(find . -name "*#"); do if test -s $f; then x=`wc -l < $f`; fi; done', ["find", "test", "wc"]),
}
_SQL_LINES = "k(signal, programs) AS (VALUES " + ", ".join(f"('{s}', {p})" for s, (_, p) in LINES.items()) + ")"
_ORDERED = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def numbered(spark, d):
    """Events with k, their number among their user's in the order of time."""
    return tables.table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


def lines_of(e, command):
    """Each event as a call of its kind's tool with this command, of which two in three have an output."""
    time = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    call = F.struct(F.lit("function_call").alias("type"), F.col("event_id").cast("string").alias("call_id"), F.col("event_type").alias("name"), F.to_json(F.struct(command.alias("command"))).alias("arguments"))
    out = F.struct(F.lit("function_call_output").alias("type"), F.col("event_id").cast("string").alias("call_id"), F.concat(F.lit("done "), F.col("event_id").cast("string")).alias("output"))
    item = lambda p, k: F.struct((F.col("k") * 2 + k).alias("pos"), F.to_json(F.struct(F.lit("response_item").alias("type"), time.alias("timestamp"), p.alias("payload"))).alias("line"))
    rows = F.filter(F.array(item(call, 0), F.when(F.col("event_id") % 3 != 0, item(out, 1))), lambda x: x.isNotNull())
    return e.select(F.col("user_id").alias("session"), F.inline(rows))


def item_lines(spark, d):
    line = F.element_at(F.create_map(*(F.lit(x) for s, (text, _) in LINES.items() for x in (s, text))), F.col("event_type"))
    return lines_of(numbered(spark, d), F.replace(line, F.lit("#"), (F.col("event_id") % 5).cast("string")))


def message_lines(spark, d):
    c = tables.table(spark, d, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    line = F.to_json(F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.struct("role", block.alias("content")).alias("message")))
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), line.alias("line"))


@query("message_log_steps", "WITH s AS (SELECT conv_id AS session, turn AS pos, CASE role WHEN 'assistant' THEN 'AGENT' WHEN 'user' THEN 'USER' ELSE 'SYSTEM' END AS source, length(text) AS chars FROM conversations WHERE coalesce(text, '') <> ''), u AS (SELECT *, coalesce(max(pos) FILTER (WHERE source = 'USER') OVER (PARTITION BY session), min(pos) FILTER (WHERE source <> 'SYSTEM') OVER (PARTITION BY session)) AS begin FROM s) SELECT session, pos, source, chars::BIGINT AS chars, row_number() OVER (PARTITION BY session ORDER BY pos) AS step FROM u WHERE pos >= begin")
def message_log_steps(spark, d):
    """Lines of messages as steps from the user's last on."""
    steps = logs.finalised(logs.message_steps(message_lines(spark, d)))
    return steps.select("session", "pos", "source", F.char_length("message").cast("long").alias("chars"), F.col("step").cast("long").alias("step"))


@query("item_log_steps", f"WITH {_ORDERED}, o AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY k) AS gap FROM n) SELECT user_id AS session, event_id::VARCHAR AS call_id, event_type AS tool, CASE WHEN event_id % 3 <> 0 THEN 'done ' || event_id END AS output, k AS step, gap AS us FROM o")
def item_log_steps(spark, d):
    """Lines of items as calls, each with its output and the time since the one before."""
    steps = logs.finalised(logs.with_outputs(logs.item_steps(item_lines(spark, d))))
    return steps.select("session", "call_id", "tool", F.get("outputs", F.lit(0)).alias("output"), F.col("step").cast("long").alias("step"), F.round(F.col("seconds") * 1e6).cast("long").alias("us"))


def _documents(spark, d, message):
    """(session, doc): each conversation as one document of messages, in order."""
    c = tables.table(spark, d, "conversations")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    return c.groupBy(F.col("conv_id").alias("session")).agg(F.concat(F.lit('{"messages":['), F.array_join(listed, ","), F.lit("]}")).alias("doc"))


_SAID = "c AS (SELECT conv_id AS session, turn, role, coalesce(text, '') AS said, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS place FROM conversations)"


@query("chat_log_steps", f"WITH {_SAID} SELECT session, place AS pos, 'message' AS kind, CASE role WHEN 'assistant' THEN 'AGENT' ELSE 'USER' END AS source, length(said)::BIGINT AS chars, NULL AS output FROM c WHERE role IN ('assistant', 'user') AND said <> '' UNION ALL SELECT session, place, k, 'AGENT', CASE k WHEN 'reasoning' THEN length('plan: turn ' || turn) ELSE length('ls ' || turn) END, CASE k WHEN 'call' THEN 'out ' || turn END FROM c, (VALUES ('reasoning'), ('call')) v(k) WHERE role = 'assistant'")
def chat_log_steps(spark, d):
    """Conversations as documents of messages with thoughts, calls and results inside."""
    agent, turn = F.col("role") == "assistant", F.col("turn").cast("string")
    response = F.struct(F.struct(F.concat(F.lit("out "), turn).alias("output")).alias("response"))
    call = F.struct(F.lit("sh").alias("name"), F.struct(F.concat(F.lit("ls "), turn).alias("command")).alias("args"), F.array(F.struct(response["response"].alias("response")).alias("functionResponse")).alias("result"))
    call = call.withField("result", F.array(F.struct(response.alias("functionResponse"))))
    thought = F.struct(F.lit("plan").alias("subject"), F.concat(F.lit("turn "), turn).alias("description"))
    message = F.struct(F.when(agent, "gemini").when(F.col("role") == "user", "user").otherwise("info").alias("type"), F.coalesce("text", F.lit("")).alias("content"), F.when(agent, F.array(thought)).alias("thoughts"), F.when(agent, F.array(call)).alias("toolCalls"))
    steps = logs.with_outputs(logs.chat_steps(_documents(spark, d, F.to_json(message))))
    return steps.select("session", F.col("pos").cast("long").alias("pos"), "kind", "source", F.char_length("message").cast("long").alias("chars"), F.get("outputs", F.lit(0)).alias("output"))


@query("document_log_steps", f"WITH {_SAID}, p AS (SELECT *, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS parts FROM c), n AS (SELECT *, sum(parts) OVER (PARTITION BY session ORDER BY place) - parts AS before FROM p) SELECT session, before + 1 AS pos, CASE role WHEN 'assistant' THEN 'AGENT' WHEN 'user' THEN 'USER' ELSE 'SYSTEM' END AS source, 'message' AS kind, said AS message, NULL AS output, strftime(TIMESTAMP '1970-01-01' + INTERVAL (turn) SECOND, '%Y-%m-%dT%H:%M:%S') AS time FROM n WHERE said <> '' UNION ALL SELECT session, before + 2, 'AGENT', 'call', 'ls', 'done', strftime(TIMESTAMP '1970-01-01' + INTERVAL (turn + 5) SECOND, '%Y-%m-%dT%H:%M:%S') FROM n WHERE role = 'assistant'")
def document_log_steps(spark, d):
    """Conversations as documents of messages with parts."""
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    state = F.struct(F.struct(F.lit("ls").alias("command")).alias("input"), F.lit("done").alias("output"), F.struct(((F.col("turn") + 5) * 1000).alias("start")).alias("time"))
    tool = F.to_json(F.struct(F.lit("tool").alias("type"), F.lit("bash").alias("tool"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("callID"), state.alias("state")))
    info = F.to_json(F.struct("role", F.struct((F.col("turn") * 1000).alias("created")).alias("time")))
    message = F.concat(F.lit('{"info":'), info, F.lit(',"parts":['), text, F.when(F.col("role") == "assistant", F.concat(F.lit(","), tool)).otherwise(""), F.lit("]}"))
    steps = logs.with_outputs(logs.document_steps(_documents(spark, d, message)))
    return steps.select("session", "pos", "source", "kind", "message", F.get("outputs", F.lit(0)).alias("output"), F.substring("timestamp", 1, 19).alias("time"))


@query("episode_log_steps", f"WITH {_SAID}, e AS (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY session ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM c) SELECT session, place AS sub, 'message' AS kind, CASE role WHEN 'user' THEN 'USER' ELSE 'SYSTEM' END AS source, CASE role WHEN 'user' THEN '' ELSE said END AS message, NULL AS output FROM e WHERE role <> 'assistant' AND later > 0 AND (role = 'user' OR said <> '') UNION ALL SELECT session, place, 'call', 'AGENT', 'ls ' || turn, (SELECT 'seen ' || f.turn FROM e f WHERE f.session = e.session AND f.place = e.place + 1 AND f.role = 'user' AND f.later > 0) FROM e WHERE role = 'assistant' UNION ALL SELECT session, place, 'reasoning', 'AGENT', 'think ' || turn, NULL FROM e WHERE role = 'assistant'")
def episode_log_steps(spark, d):
    """Conversations as requests of a terminal session, each of which repeats all that was said before."""
    turn = F.col("turn").cast("string")
    c = tables.table(spark, d, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    shown = F.when(F.col("role") == "user", F.concat(F.lit("New Terminal Output:\nseen "), turn)).otherwise(F.coalesce("text", F.lit("")))
    said = F.struct("place", "role", shown.alias("content"))
    before = F.collect_list(said).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    command = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("ls "), turn).alias("keystrokes"))).alias("commands")))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("<think>think "), turn, F.lit("</think>"), command).alias("content")).alias("message"))).alias("choices")))
    doc = F.to_json(F.struct(before.alias("input"), answer.alias("original_response")))
    docs = c.withColumn("doc", doc).where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("episode"), "doc", "place")
    places = docs.select("session", F.col("episode").cast("long").alias("pos"), F.col("place").alias("at"))
    steps = logs.with_outputs(logs.episode_steps(docs)).join(places, ["session", "pos"])
    kept = steps.where("kind <> 'message' OR source <> 'AGENT'")
    sub = F.when(F.col("source") == "AGENT", F.col("at")).otherwise(F.floor(F.col("sub") / 2))
    message = F.when(F.col("source") == "USER", F.lit("")).otherwise(F.col("message"))
    return kept.select("session", sub.cast("long").alias("sub"), "kind", "source", message.alias("message"), F.get("outputs", F.lit(0)).alias("output"))


_SCRIPTS = "s AS (SELECT *, event_id % 3 AS slot, 1 + event_id % 4 AS size FROM n), r AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN size END IGNORE NULLS) OVER (PARTITION BY user_id, slot ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written FROM s)"


@query("script_runs", f"WITH {_ORDERED}, {_SCRIPTS} SELECT user_id AS session, event_id::VARCHAR AS call_id, CASE event_type WHEN 'view' THEN 'script' WHEN 'purchase' THEN 'code' ELSE 'heredoc' END AS mode, CASE event_type WHEN 'view' THEN written + 1 WHEN 'purchase' THEN 2 ELSE 2 * size END AS code_lines, CASE event_type WHEN 'view' THEN coalesce(written, 0) WHEN 'purchase' THEN 1 ELSE 0 END AS library_calls, (event_id % 3 <> 0)::BIGINT AS output_lines FROM r WHERE event_type IN ('view', 'purchase', 'error')")
def script_runs(spark, d):
    """Python in the lines of calls, that of script files taken from the call that wrote them last."""
    slot, size, kind = (F.col("event_id") % 3).cast("string"), (1 + F.col("event_id") % 4).cast("int"), F.col("event_type")
    write = F.concat(F.lit("cat > ./s"), slot, F.lit(".py <<'EOF'\nimport numpy as np\n"), F.repeat(F.lit("np.zeros(1)\n"), size), F.lit("EOF"))
    run = F.concat(F.lit("ls && X=1 python3 -u s"), slot, F.lit(".py | tail"))
    given = F.concat(F.lit("x=$(python -c 'import os\nos.getcwd()')"))
    here = F.concat(F.lit("python - <<EOF\n"), F.repeat(F.lit("print(1)\n\nlen('')\n"), size), F.lit("EOF"))
    command = F.when(kind == "click", write).when(kind == "view", run).when(kind == "purchase", given).when(kind == "error", here).otherwise("pwd")
    calls = logs.with_outputs(logs.item_steps(lines_of(numbered(spark, d), command)))
    runs = logs.script_runs(calls, F.get_json_object("arguments", "$.command"))
    n_calls = F.aggregate(F.map_values(F.coalesce("libraries", F.create_map().cast("map<string,int>"))), F.lit(0), lambda n, x: n + x)
    return runs.select("session", "call_id", "mode", "code_lines", n_calls.alias("library_calls"), "output_lines")


@query("log_tool_counts", "SELECT user_id AS session, event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 <> 0) AS answered FROM events GROUP BY ALL")
def log_tool_counts(spark, d):
    return logs.tool_counts(logs.with_outputs(logs.item_steps(item_lines(spark, d))))


@query("log_command_counts", f"WITH {_SQL_LINES}, p AS (SELECT user_id AS session, event_id, unnest(programs) AS program FROM events JOIN k ON k.signal = event_type) SELECT session, program, count(*) AS uses, count(DISTINCT event_id) AS calls FROM p GROUP BY ALL")
def log_command_counts(spark, d):
    """Programs in the shell lines of calls."""
    return logs.command_counts(logs.item_steps(item_lines(spark, d)), F.get_json_object("arguments", "$.command"))


@query("log_cat_classes", "SELECT CASE event_type WHEN 'click' THEN 'concat' WHEN 'error' THEN 'heredoc_write' END AS class, count(*) AS calls FROM events GROUP BY 1")
def log_cat_classes(spark, d):
    calls = logs.item_steps(item_lines(spark, d)).where("kind = 'call'")
    return calls.groupBy(logs.cat_class_of(F.get_json_object("arguments", "$.command")).alias("class")).agg(F.count(F.lit(1)).alias("calls"))


@query("log_library_calls", "WITH n AS (SELECT p_partkey, p_size FROM part) SELECT name, sum(n)::BIGINT AS calls FROM (SELECT 'numpy.linalg.norm' AS name, 1 AS n FROM n UNION ALL SELECT 'pandas.read_csv', p_size % 3 FROM n UNION ALL SELECT 'os.path.join', 1 FROM n WHERE p_size % 2 = 0) GROUP BY name")
def log_library_calls(spark, d):
    """Calls of imported libraries in Python texts; broken texts have none."""
    size = F.col("p_size")
    code = F.concat(F.lit("import numpy as np\nfrom pandas import read_csv\nnp.linalg.norm([1])\nprint(2)\n"), F.repeat(F.lit("read_csv('x')\n"), size % 3), F.when(size % 2 == 0, "import os.path\nos.path.join('a')\n").otherwise(""))
    calls = tables.table(spark, d, "part").select(F.explode(logs.library_calls_of(code)).alias("name", "n"))
    return calls.groupBy("name").agg(F.sum("n").alias("calls"))


@query("log_costs", f"WITH t AS (SELECT l_orderkey AS session, sum(l_quantity)::BIGINT AS prompt, sum(l_linenumber * 9)::BIGINT AS cached, sum(l_suppkey)::BIGINT AS completion FROM lineitem GROUP BY 1) SELECT session, {q('((CASE WHEN cached > prompt THEN prompt + cached ELSE prompt END - cached) * 3.0 + cached * 0.3 + completion * 15.0) / 1e6')} AS cost FROM t")
def log_costs(spark, d):
    t = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.sum("l_quantity").cast("long").alias("prompt"), F.sum(F.col("l_linenumber") * 9).alias("cached"), F.sum("l_suppkey").alias("completion"))
    return t.select("session", X.scaled(logs.cost(F.col("prompt"), F.col("cached"), F.col("completion"), F.lit(3.0), F.lit(0.3), F.lit(15.0))).alias("cost"))


@query("log_token_faults", "WITH s AS (SELECT l_orderkey AS session, sum(l_linenumber) AS prompt, sum(l_suppkey) AS completion FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey AS session, coalesce(prompt, 0) + (o_orderkey % 20 = 0)::INT AS prompt, coalesce(completion, 0) - (o_orderkey % 33 = 0)::INT AS completion, coalesce(prompt, 0) AS sp, coalesce(completion, 0) AS sc FROM orders LEFT JOIN s ON session = o_orderkey) SELECT session, 'prompt' AS field, sp::BIGINT AS steps, prompt::BIGINT AS final FROM f WHERE prompt <> sp UNION ALL SELECT session, 'completion', sc::BIGINT, completion::BIGINT FROM f WHERE completion <> sc")
def log_token_faults(spark, d):
    """Sessions whose steps' tokens don't add up to the final figures."""
    steps = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("prompt"), F.col("l_suppkey").alias("completion"))
    sums = steps.groupBy("session").agg(F.sum("prompt").alias("p"), F.sum("completion").alias("c"))
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("session")).join(sums, "session", "left")
    k = F.col("session")
    finals = o.select("session", (F.coalesce("p", F.lit(0)) + (k % 20 == 0).cast("int")).alias("prompt"), (F.coalesce("c", F.lit(0)) - (k % 33 == 0).cast("int")).alias("completion"))
    return logs.token_faults(steps, finals, ["prompt", "completion"])


@query("log_payloads", f"WITH {_SQL_LINES}, {_ORDERED}, t AS (SELECT user_id, array_to_string(list(event_type || ':' || c ORDER BY event_type), ',') AS tools FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY 1), p AS (SELECT user_id, array_to_string(list(program || ':' || c ORDER BY program), ',') AS programs FROM (SELECT user_id, program, count(*) AS c FROM (SELECT user_id, unnest(programs) AS program FROM events JOIN k ON k.signal = event_type) GROUP BY ALL) GROUP BY 1), o AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY k) AS us FROM n) SELECT user_id AS session, count(*) AS steps, 0 AS users, count(*) AS agents, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 <> 0) AS answered, sum(us)::BIGINT AS us, max(tools) AS tools, max(programs) AS programs FROM o JOIN t USING (user_id) JOIN p USING (user_id) GROUP BY user_id")
def log_payloads(spark, d):
    """All figures of each log in one row."""
    steps = logs.finalised(logs.with_outputs(logs.item_steps(item_lines(spark, d))))
    p = logs.payload(steps, F.get_json_object("arguments", "$.command"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return p.select("session", "steps", "users", "agents", "calls", "answered", F.round(F.col("seconds") * 1e6).cast("long").alias("us"), listed("tools").alias("tools"), listed("programs").alias("programs"))


@query("light_logs", f"WITH {_ORDERED} SELECT user_id AS session, array_to_string(list(k || ' ' || event_type || ' ' || event_id || CASE WHEN event_id % 3 <> 0 THEN ' done ' || event_id ELSE '' END ORDER BY k), ';') AS steps FROM n GROUP BY user_id")
def light_logs(spark, d):
    """What a reader needs of each log, written out."""
    steps = logs.finalised(logs.with_outputs(logs.item_steps(item_lines(spark, d))))
    said = F.transform("steps", lambda s: F.array_join(F.concat(F.array(s["step"].cast("string"), s["call"]["tool"], s["call"]["call_id"]), s["outputs"]), " "))
    return logs.light(steps).select("session", F.array_join(said, ";").alias("steps"))
