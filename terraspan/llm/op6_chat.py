"""Operator 6: linking tool calls to their results, in order, validated, as canonical JSON.

Native: DataFrame functions only. ``link`` takes calls ``(call_id, name, arguments, depends)``
with arguments as JSON text and depends as an array of call ids, and results ``(call_id,
content)``. Results meet calls by a hash join on the identifier. Calls are ordered
topologically: a call's level is the longest way back to a call without dependencies; in or
behind a cycle it is null. A dependency that another one has too is no longest way and is dropped first, so calls that name
several calls before them are chains still. Chains are measured by pointer doubling and what joins several
chains in rounds, all by joins on identifiers, so no task holds a conversation and a
conversation of n turns takes log2(n) rounds. Arguments are parsed once and checked against schemas with nested objects, arrays and lists of allowed values,
an operator parameter compiled into column expressions, and the record is written as
canonical JSON: keys in order, no blanks, one escape for each character that needs one,
integral numbers as digits and others as the shortest form of a double. Arguments that fail
their schema have no canonical object; the record holds their text as a string, unchanged.

``query`` reads ``conversations`` as calls: a user message is a call of ``reply`` and a system
message one of ``configure``; the assistant's message of the next turn is the result; a call
depends on the system message or the answered call before it. The argument ``words`` counts the
message's words and ``style`` is an object; so that validation has something to find, by that count modulo 8 some calls
have a string inside for a truth value (1) or a number (2), a word that isn't allowed (4), leave ``words`` out (3), give it as a string (5), add a key (6) or break off (7).

Defined cases: a null role or text is empty, other roles than system, user and assistant
are ignored; repeated or rival messages of one (conv_id, turn) count once, the smallest role
and text first; messages with a null conv_id or turn are calls without links; a dependency
that isn't among the calls is dropped; a call without result has a null result; arguments
that aren't JSON (or exceed what Spark's variants hold; 20 MB fit), or lack a key, or have a key of another type, an unknown one, a value that isn't allowed, or an
unknown tool name, are listed in ``errors`` by the key's path (``a.b[]`` for items of b in a), each once; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pinned, release, table

#: Tool name to argument names: the type, and whether it's required. A type is string, integer, number or boolean; a tuple of the
#: strings allowed; a list of the one type of an array's items; or an object's own names, again with their types.
STYLE = {"long": ("boolean", True), "sizes": (["integer"], True), "unit": (("word", "line"), False)}
SCHEMAS = {
    "configure": {"instructions": ("string", True), "words": ("integer", True), "style": (STYLE, False)},
    "reply": {"prompt": ("string", True), "words": ("integer", True), "style": (STYLE, False)},
}
#: Fixed values of JSON: the characters with a short escape. Other control characters are written in hexadecimal.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _get(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$['{key}']", kind)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _one(message: str) -> Column:
    return F.array(F.lit(message))


def _fits(value: Column, wanted: str) -> Column:
    """Whether a value has the JSON type ``wanted``."""
    got = F.schema_of_variant(value)
    number = (got == "BIGINT") | got.startswith("DECIMAL") | (got == "DOUBLE")
    if wanted == "integer":
        double = _as(value, "double")
        return (got == "BIGINT") | number & (double == F.floor(double)) & (F.abs(double) < 2.0**53)
    return {"string": got == "STRING", "number": number, "boolean": got == "BOOLEAN"}[wanted]


def _check(value: Column, wanted, path: str) -> Column:
    """What is wrong with a value that is there, as an array."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fault = _one(f"type {path}")
    if isinstance(wanted, str):
        return F.when(~yes(_fits(value, wanted)), fault).otherwise(_none())
    if isinstance(wanted, tuple):
        return F.when(~yes(_fits(value, "string")), fault).when(~_as(value, "string").isin(*wanted), _one(f"value {path}")).otherwise(_none())
    if isinstance(wanted, list):
        items = _as(value, "array<variant>")
        return F.when(~yes(F.schema_of_variant(value).startswith("ARRAY")), fault).otherwise(F.flatten(F.transform(items, lambda x: _check(x, wanted[0], f"{path}[]"))))
    return F.when(~yes(F.schema_of_variant(value).startswith("OBJECT")), fault).otherwise(_members(value, wanted, f"{path}."))


def _members(value: Column, fields: dict, path: str) -> Column:
    """What is wrong with the members of an object."""
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), _none())
    found = []
    for key, (wanted, required) in fields.items():
        missing = _one(f"missing {path}{key}") if required else _none()
        found.append(F.when(~F.array_contains(keys, key), missing).otherwise(_check(_get(value, key), wanted, f"{path}{key}")))
    extra = F.transform(F.array_except(keys, F.array(*(F.lit(k) for k in fields)) if fields else _none()), lambda k: F.concat(F.lit(f"unexpected {path}"), k))
    return F.concat(*found, extra)


def errors_of(name: Column, parsed: Column, schemas: dict) -> Column:
    """What is wrong with the ``parsed`` arguments of a call, sorted and joined by commas; empty if nothing."""
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    found = F.when(~is_object, _one("not an object")).when(name.isNull() | ~name.isin(*schemas), _one("unknown tool"))
    for tool, fields in schemas.items():
        found = found.when(name == tool, _members(parsed, fields, ""))
    return F.array_join(F.array_sort(F.array_distinct(found)), ",")


def quoted(value: Column) -> Column:
    """A string of any length as JSON, null as the word null."""
    out = value
    for c, escape in ESCAPES.items():
        out = F.replace(out, F.lit(c), F.lit(escape))
    rare = out
    for c in map(chr, range(32)):
        if c not in ESCAPES:
            rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    out = F.when(value.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def _written(value: Column, wanted) -> Column:
    """A value of the type ``wanted`` as canonical JSON."""
    if isinstance(wanted, tuple) or wanted == "string":
        return quoted(_as(value, "string"))
    if isinstance(wanted, list):
        return F.concat(F.lit("["), F.array_join(F.transform(_as(value, "array<variant>"), lambda x: _written(x, wanted[0])), ","), F.lit("]"))
    if isinstance(wanted, dict):
        parts = [F.when(_get(value, k).isNotNull(), F.concat(quoted(F.lit(k)), F.lit(":"), _written(_get(value, k), w))) for k, (w, _) in sorted(wanted.items())]
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ",") if parts else F.lit(""), F.lit("}"))
    number = _as(value, "double")
    digits = F.coalesce(_as(value, "long"), number.cast("long")).cast("string")
    return {"integer": digits, "boolean": _as(value, "boolean").cast("string"), "number": F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), digits).otherwise(number.cast("string"))}[wanted]


def canonical(name: Column, arguments: Column, parsed: Column, errors: Column, schemas: dict) -> Column:
    """Valid arguments as a canonical object, others as the string that they are."""
    out = F.when(errors != "", quoted(arguments))
    for tool, fields in schemas.items():
        out = out.when(name == tool, _written(parsed, fields))
    return F.coalesce(out, F.lit("null"))


def _longest(depends: DataFrame) -> DataFrame:
    """The edges ``(call_id, on_id)`` without those that a way over two edges makes needless. Where there are cycles this may take too many."""
    several = depends.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("call_id")
    first = depends.join(several, "call_id", "left_semi").filter("call_id <> on_id").select("call_id", F.col("on_id").alias("_by"))
    second = depends.filter("call_id <> on_id").select(F.col("call_id").alias("_by"), "on_id")
    return depends.join(first.join(second, "_by").select("call_id", "on_id"), ["call_id", "on_id"], "left_anti")


def _chains(depends: DataFrame) -> DataFrame:
    """``(node, root, dist)`` of calls with one dependency: the first call before them with none or several, and how far.

    Pointers double in every round, so a chain of n calls takes log2(n) rounds. What still points
    into the chains after as many rounds as could be needed is in or behind a cycle, and is left out.
    """
    one = depends.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"), F.min("on_id").alias("root")).filter("_n = 1")
    now = materialize(one.select(F.col("call_id").alias("node"), "root", F.lit(1).cast("long").alias("dist")))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("node").alias("_node"), F.col("root").alias("_root"), F.col("dist").alias("_dist"))
        both = now.join(ahead, F.col("root") == F.col("_node"), "left")
        after = materialize(both.select("node", F.coalesce("_root", "root").alias("root"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.col("_node").isNotNull().alias("moved")))
        release(now)
        now = after.drop("moved")
        now._scratch_path = after._scratch_path
        if after.filter("moved").isEmpty():
            return now
    return now.join(now.select(F.col("node").alias("root")), "root", "left_anti").select("node", "root", "dist")


def levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """``(call_id, level)`` for all calls outside and not behind cycles, given edges ``(call_id, on_id)`` among them.

    Needless edges are left out; levels found so are right if they climb along every edge that was given. Else a cycle
    was opened, and all edges are taken.
    """
    given = materialize(depends.select("call_id", "on_id").distinct())
    found = materialize(_levels(calls, materialize(_longest(given))))
    on = found.select(F.col("call_id").alias("on_id"), F.col("level").alias("_below"))
    steps = given.join(found, "call_id").join(on, "on_id", "left")
    return found if steps.filter(F.col("_below").isNull() | (F.col("level") <= F.col("_below"))).isEmpty() else _levels(calls, given)


def _levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """The levels by all of the edges ``depends``, a written table without repeats.

    Chains are measured by ``_chains``; only calls with several dependencies are then freed in
    rounds, one round for each that lie behind one another.
    """
    chains = _chains(depends)
    behind = depends.join(chains.select(F.col("node").alias("call_id")), "call_id", "left_anti").join(chains.withColumnRenamed("node", "on_id"), "on_id", "left")
    single = depends.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("call_id")
    left = materialize(behind.join(single, "call_id", "left_semi").select("call_id", F.coalesce("root", "on_id").alias("on_id"), (F.coalesce("dist", F.lit(0)) + 1).alias("step"), F.lit(0).cast("long").alias("least")))
    known = materialize(calls.select("call_id").distinct().join(depends.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")))
    done, fresh = [known], known
    while not left.isEmpty() and not fresh.isEmpty():
        met = left.join(fresh.withColumnRenamed("call_id", "on_id"), "on_id", "left")
        part = met.groupBy("call_id").agg(
            F.max(F.greatest("least", F.coalesce(F.col("level") + F.col("step"), F.lit(0)))).alias("level"), F.count(F.when(F.col("level").isNull() & (F.col("step") > 0), 1)).alias("_open"),
            F.collect_list(F.when(F.col("level").isNull() & (F.col("step") > 0), F.struct("on_id", "step"))).alias("_rest"),
        )
        part = materialize(part)
        fresh = part.filter("_open = 0").select("call_id", "level")
        release(left)
        left = materialize(part.filter("_open > 0").select("call_id", F.explode("_rest").alias("r"), F.col("level").alias("least")).select("call_id", "r.on_id", "r.step", "least"))
        done.append(fresh)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    along = chains.join(out.withColumnRenamed("call_id", "root"), "root").select(F.col("node").alias("call_id"), (F.col("level") + F.col("dist")).alias("level"))
    return out.unionByName(along).withColumn("level", F.col("level").cast("int"))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row a call: ``call_id, name, level, depends, answered, errors, record``; other columns of ``calls`` stay."""
    own = [c for c in calls.columns if c.lower() not in ("call_id", "name", "arguments", "depends", "level", "answered", "errors", "record")]
    calls = materialize(calls.select("call_id", "name", "arguments", "depends", *own))
    wanted = calls.select("call_id", F.explode("depends").alias("on_id")).filter("on_id is not null and call_id is not null").distinct()
    known = wanted.join(calls.select(F.col("call_id").alias("on_id")).distinct(), "on_id", "left_semi")
    edges = materialize(known.select("call_id", "on_id"))
    grouped = edges.groupBy("call_id").agg(F.array_sort(F.collect_set("on_id")).alias("depends"))
    content = results.groupBy("call_id").agg(F.min("content").alias("_result"), F.lit(True).alias("answered"))
    out = calls.drop("depends").join(content, "call_id", "left").join(grouped, "call_id", "left").join(levels(calls.filter("call_id is not null"), edges), "call_id", "left")
    out = out.withColumn("level", F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level")))
    out = out.withColumn("depends", F.coalesce("depends", F.array().cast("array<string>"))).withColumn("answered", F.coalesce("answered", F.lit(False)))
    out = pinned(out, "_parsed", F.try_parse_json("arguments"))
    out = pinned(out, "errors", errors_of(F.col("name"), F.col("_parsed"), schemas))
    out = pinned(out, "_canonical", canonical(F.col("name"), F.col("arguments"), F.col("_parsed"), F.col("errors"), schemas))
    record = F.concat(
        F.lit('{"arguments":'), F.col("_canonical"), F.lit(',"depends":['), F.array_join(F.transform("depends", quoted), ","),
        F.lit('],"id":'), quoted(F.col("call_id")), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(F.col("_result")), F.lit(',"valid":'), F.when(F.col("errors") == "", "true").otherwise("false"), F.lit("}"),
    )
    return out.withColumn("record", record).select("call_id", "name", "level", "depends", "answered", "errors", "record", *own)


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (see the module)."""
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    asked = said.filter(F.col("role").isin("user", "system")).groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.*")
    words = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long")
    key = F.when(F.col("role") == "user", "prompt").otherwise("instructions")
    count, kind = words.cast("string"), words % 8
    given = F.when(kind == 3, F.lit("")).when(kind == 5, F.concat(F.lit('"words":"'), count, F.lit('",'))).otherwise(F.concat(F.lit('"words":'), count, F.lit(",")))
    unit = F.when(kind == 4, "page").when(kind % 2 == 0, "word").otherwise("line")
    style = F.concat(
        F.lit('"style":{ "unit":"'), unit, F.lit('","sizes":['), count, F.lit(" , "), F.when(kind == 2, F.lit('"2"')).otherwise(F.concat((words + 1).cast("string"), F.lit(".0"))), F.lit('],"long":'),
        F.when(kind == 1, F.lit('"yes"')).otherwise((words > 40).cast("string")), F.lit("} ,"),
    )
    arguments = F.concat(F.lit("{"), given, style, F.when(kind == 6, F.lit('"more":true,')).otherwise(F.lit("")), F.lit('"'), key, F.lit('":'), F.when(kind == 7, F.lit("")).otherwise(F.concat(quoted(F.col("text")), F.lit("}"))))
    calls = asked.select(
        ident(0).alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        arguments.alias("arguments"),
        F.array(ident(1), ident(2)).alias("depends"), "conv_id", "turn",
    )
    answers = said.filter((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return calls, answers.select(ident(1).alias("call_id"), F.col("text").alias("content"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every conversation."""
    out = link(*calls_of(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "call_id", "name", "level", F.array_join("depends", ",").alias("depends"), "answered", "errors", "record")


SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, min(role) AS role
  FROM conversations WHERE role IN ('user', 'system') GROUP BY conv_id, turn
), first AS (
  SELECT c.conv_id, c.turn, c.call_id, c.role, m.text, len(list_filter(string_split(m.text, ' '), lambda w: w <> '')) AS n,
         CASE c.role WHEN 'user' THEN 'prompt' ELSE 'instructions' END AS key
  FROM calls c JOIN (SELECT conv_id, turn, role, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL) m
    ON m.conv_id = c.conv_id AND m.turn = c.turn AND m.role = c.role
), answers AS (
  SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), edges AS (
  SELECT a.call_id, b.call_id AS on_id FROM first a JOIN first b ON a.conv_id = b.conv_id AND (b.turn = a.turn - 1 OR b.turn = a.turn - 2)
), walk AS (
  SELECT call_id, 0 AS level FROM first
  UNION
  SELECT e.call_id, w.level + 1 FROM walk w JOIN edges e ON e.on_id = w.call_id
), level AS (SELECT call_id, max(level) AS level FROM walk GROUP BY call_id
), deps AS (SELECT call_id, string_agg(on_id, ',' ORDER BY on_id) AS depends, string_agg('"' || on_id || '"', ',' ORDER BY on_id) AS quoted FROM edges GROUP BY call_id
), judged AS (
  SELECT *, CASE n % 8 WHEN 1 THEN 'type style.long' WHEN 2 THEN 'type style.sizes[]' WHEN 4 THEN 'value style.unit' WHEN 3 THEN 'missing words' WHEN 5 THEN 'type words' WHEN 6 THEN 'unexpected more' WHEN 7 THEN 'not an object' ELSE '' END AS errors,
         CASE n % 8 WHEN 3 THEN '{' WHEN 5 THEN '{"words":"' || n || '",' ELSE '{"words":' || n || ',' END
           || '"style":{ "unit":"' || CASE WHEN n % 8 = 4 THEN 'page' WHEN n % 2 = 0 THEN 'word' ELSE 'line' END || '","sizes":[' || n || ' , ' || CASE n % 8 WHEN 2 THEN '"2"' ELSE (n + 1) || '.0' END
           || '],"long":' || CASE n % 8 WHEN 1 THEN '"yes"' ELSE CASE WHEN n > 40 THEN 'true' ELSE 'false' END END || '} ,' || CASE n % 8 WHEN 6 THEN '"more":true,' ELSE '' END
           || '"' || key || '":' || CASE n % 8 WHEN 7 THEN '' ELSE to_json(text)::VARCHAR || '}' END AS raw
  FROM first
)
SELECT f.conv_id, f.turn, f.call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, l.level::INTEGER AS level,
       coalesce(depends, '') AS depends, content IS NOT NULL AS answered, errors,
       '{"arguments":' || CASE errors WHEN '' THEN '{"' || key || '":' || to_json(f.text)::VARCHAR || ',"style":{"long":' || CASE WHEN n > 40 THEN 'true' ELSE 'false' END || ',"sizes":[' || n || ',' || n + 1 || '],"unit":"' || CASE WHEN n % 2 = 0 THEN 'word' ELSE 'line' END || '"},"words":' || n || '}' ELSE to_json(raw)::VARCHAR END
         || ',"depends":[' || coalesce(quoted, '') || '],"id":"' || f.call_id || '","level":' || l.level
         || ',"name":"' || CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
         || ',"valid":' || CASE errors WHEN '' THEN 'true' ELSE 'false' END || '}' AS record
FROM judged f JOIN level l USING (call_id) LEFT JOIN deps d USING (call_id) LEFT JOIN answers a ON a.conv_id = f.conv_id AND a.turn = f.turn
"""
