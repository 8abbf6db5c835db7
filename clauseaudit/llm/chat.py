r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is ``### <role>: <text></turn>\n``.  Rendered text is parsed again by a deterministic parser and the
recovered turns are compared with the source.  Texts are first laid out as they are; where the turns come
back different, those texts that do not survive on their own are escaped, and then all texts, until both
are identical.  Escaping puts a backslash before a backslash and inside ``</turn>`` and ``### ``;
reading removes one backslash before any character.  Roles are percent-encoded (``% : < #``).

Null texts and roles are empty strings.  Turns are ordered by (turn, role, text), so ties and repeated rows
have one order.  A null conv_id is a conversation of its own.  An empty table gives no rows; other columns are
ignored.  A conversation is one row of output and so must fit in a row, whatever its texts' length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def _escape(x: str) -> str:
    return rf"replace(replace(replace({x}, r'\', r'\\'), '</turn>', r'<\/turn>'), '### ', r'\### ')"


def _unescape(x: str) -> str:
    return rf"regexp_replace({x}, r'(?s)\\(.)', '$1')"


def _role(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23')"


def _unrole(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '%23', '#'), '%3C', '<'), '%3A', ':'), '%25', '%')"


def _render(turns: str) -> str:
    """Text of an array of (role, body)."""
    return f"array_join(transform({turns}, t -> concat('### ', {_role('t.role')}, ': ', t.body, '</turn>\\n')), '')"


def _parse(text: str) -> str:
    """Turns (role, text) of a rendered text; a piece that breaks the grammar has a null text."""
    piece = "substr(p, 5 + locate(': ', substr(p, 5)) + 1)"
    sound = rf"startswith(p, '### ') and locate(': ', substr(p, 5)) > 0 and not contains({piece}, '</turn>') and not {piece} rlike r'(?<!\\)### '"
    return (
        f"transform(slice(split({text}, '</turn>\\n', -1), 1, size(split({text}, '</turn>\\n', -1)) - 1), p -> named_struct("
        f"'role', if({sound}, {_unrole("substr(p, 5, locate(': ', substr(p, 5)) - 1)")}, cast(null as string)), "
        f"'text', if({sound}, {_unescape(piece)}, cast(null as string))))"
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, n_turns, formatted, loss (array of start and length in code points,
    the assistant's bodies), turns (read back from formatted) and identical (source and reading agree)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    x = x.select("conv_id", F.expr("transform(all, t -> named_struct('role', t.role, 'text', t.text))").alias("source"))
    plain = "named_struct('role', t.role, 'body', t.text)"
    escaped = f"named_struct('role', t.role, 'body', {_escape('t.text')})"
    alone = _parse(_render("array(named_struct('role', s.role, 'body', s.text))"))
    survives = f"transform(source, s -> {alone} = array(s))"
    x = x.withColumn("first", F.expr(f"transform(source, t -> {plain})"))
    x = x.withColumn("parsed", F.expr(_parse(_render("first"))))
    x = x.withColumn("second", F.when(F.expr("parsed = source"), F.col("first")).otherwise(F.expr(f"zip_with(source, {survives}, (t, ok) -> if(ok, {plain}, {escaped}))")))
    x = x.withColumn("parsed", F.when(F.expr("parsed = source"), F.col("parsed")).otherwise(F.expr(_parse(_render("second")))))
    x = x.withColumn("bodies", F.when(F.expr("parsed = source"), F.col("second")).otherwise(F.expr(f"transform(source, t -> {escaped})")))
    x = x.withColumn("formatted", F.expr(_render("bodies")))
    x = x.withColumn("turns", F.expr(_parse("formatted")))
    # Where bodies begin: running length of all turns before, and the turn's own header.
    spans = f"""aggregate(bodies, named_struct('at', 1, 'loss', cast(array() as array<struct<start:int,length:int>>)), (a, t) -> named_struct(
        'at', a.at + length(concat('### ', {_role('t.role')}, ': ')) + length(t.body) + 8,
        'loss', if(t.role = 'assistant', concat(a.loss, array(named_struct('start', a.at + length(concat('### ', {_role('t.role')}, ': ')), 'length', length(t.body)))), a.loss)), a -> a.loss)"""
    return x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", F.expr(spans).alias("loss"), "turns", F.expr("turns = source").alias("identical"))


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from ``format_chat``'s output."""
    x = formatted.withColumn("masked", F.expr(f"array_join(transform(loss, s -> {_unescape('substr(formatted, s.start, s.length)')}), '')"))
    every = "array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    return x.select(
        "conv_id", "n_turns", F.sha2(F.expr(every), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB: a text is escaped if it does not survive raw: a control string, or a backslash with a character after it.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
bodies AS (
  SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR regexp_matches(text, '\\.', 's')
    THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\### ') ELSE text END AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23')) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM bodies GROUP BY conv_id
"""
