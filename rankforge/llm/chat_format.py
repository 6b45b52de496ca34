r"""Chat formatting by schema fingerprints.

Records come in many layouts: a row per turn, lists of messages under several names,
prompt and response, instruction and output. The set of a record's nested field paths
is hashed, and the hash selects a declarative mapping that reads the record as
turns (role, text). New layouts are new entries of ``LAYOUTS``; a record in no known
layout stays in the result without turns, and ``unknown_layouts`` counts them.

Turns are written as ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside
roles and texts get a backslash after their first character (one more where there are
some already), so a marker in the output is always a marker, and taking one backslash
away restores the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import col

# The template's markers, and the control strings that are escaped.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL_ANGLE = r"\||/?s>|/?SYS>"
CONTROL_SQUARE = r"/?INST\]"
TURN = "struct<turn:bigint,role:string,text:string>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How records with exactly these field paths become turns.

    ``one``: the record is a turn (conversation, turn, role and text are its fields).
    ``many``: (list, role field, text field); a text field ``a[].b`` joins the parts.
    ``flat``: (role, fields) in order; several fields are joined by a blank line.
    ``optional`` paths may be absent. Roles outside ``one`` pass through ``ROLES``.
    """
    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    one: tuple[str, str, str, str] | None = None
    many: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def shapes(self) -> list[str]:
        out = []
        for n in range(len(self.optional) + 1):
            out += [shape_of((*self.paths, *some)) for some in combinations(self.optional, n)]
        if self.many:
            out.append(shape_of([p for p in self.paths if not p.startswith(self.many[0] + "[]")] + [self.many[0] + "[]"]))
        return out


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), one=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), ("id", "system"), many=("messages", "role", "content")),
    Layout("message parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), ("id",), many=("messages", "role", "content[].text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("id", "system"), many=("conversations", "from", "value")),
    Layout("prompt and response", ("prompt", "response"), ("id", "system"), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), ("id",), flat=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system"), flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", ("question", "answer"), ("id", "context"), flat=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


# fingerprints

def shape_of(paths) -> str:
    """Nested field paths as one string: objects with their fields in order, lists."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            name, depth = part.rstrip("[]"), part.count("[]")
            at = at.setdefault((name, depth), {})

    def write(node: dict) -> str:
        fields = []
        for (name, depth), below in sorted(node.items()):
            inner = write(below) if below else "VOID" if depth else ""
            fields.append(f"{name}: {'ARRAY<' * depth}{inner}{'>' * depth}" if inner else name)
        return f"OBJECT<{', '.join(fields)}>"

    return write(tree)


def shape(body: Column) -> Column:
    """The shape of a record: its nested field paths without the types of its values."""
    return F.regexp_replace(F.schema_of_variant(body), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]+\))?", "")


def fingerprint(body: Column) -> Column:
    return F.xxhash64(shape(body))


# records to turns

def _get(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, f"$.{path}", kind)


def _turns(layout: Layout, body: Column) -> Column:
    def turn(n: Column, role: Column, text: Column) -> Column:
        return F.struct(n.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))

    def known(role: Column) -> Column:
        out = role
        for other, own in ROLES.items():
            out = F.when(F.lower(role) == other, own).otherwise(out)
        return out

    if layout.one:
        _, n, role, text = layout.one
        return F.array(turn(_get(body, n, "bigint"), _get(body, role), _get(body, text)))
    if layout.many:
        name, role, text = layout.many
        whole, _, part = text.partition("[].")
        kind = f"array<struct<{part}:string>>" if part else "string"
        items = F.coalesce(_get(body, name, f"array<struct<`{role}`:string,`{whole}`:{kind}>>"), F.array().cast(f"array<struct<`{role}`:string,`{whole}`:{kind}>>"))
        said = (lambda m: F.array_join(F.transform(m[whole], lambda p: p[part]), "")) if part else (lambda m: m[whole])
        turns = F.transform(items, lambda m, i: turn(i, known(m[role]), said(m)))
        system = _get(body, "system")
        return F.when(system.isNull(), turns).otherwise(F.concat(F.array(turn(F.lit(-1), F.lit("system"), system)), turns))
    found = []
    for n, (role, fields) in enumerate(layout.flat):
        texts = F.filter(F.array(*[_get(body, f) for f in fields]), lambda t: t.isNotNull() & (t != ""))
        made = turn(F.lit(n), F.lit(role), F.array_join(texts, "\n\n"))
        found.append(F.when(_get(body, "system").isNotNull(), made) if role == "system" else made)
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame, key: str = "conv_id", body: str = "body", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turn, role, text) from records of (key, body), body a variant.

    A record in the layout of a turn names its conversation itself. Records in an unknown
    layout, and records without turns, leave one row without turn and role.
    """
    marked = records.select(col(key).cast("bigint").alias("_key"), col(body).alias("_body"), fingerprint(col(body)).alias("_print"))
    name, turns, conv = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>"), F.col("_key")
    for layout in reversed(layouts):
        here = F.col("_print").isin(*[p for p in _prints(layout, records)])
        name = F.when(here, layout.name).otherwise(name)
        turns = F.when(here, _turns(layout, F.col("_body"))).otherwise(turns)
        if layout.one:
            conv = F.when(here, _get(F.col("_body"), layout.one[0], "bigint")).otherwise(conv)
    return (
        marked.select(conv.alias("conv_id"), name.alias("layout"), F.explode_outer(turns).alias("_t"))
        .select("conv_id", "layout", "_t.turn", F.when(F.col("_t").isNotNull(), F.coalesce("_t.role", F.lit(""))).alias("role"), F.coalesce("_t.text", F.lit("")).alias("text"))
    )


def _prints(layout: Layout, records: DataFrame) -> list[int]:
    shapes = layout.shapes()
    row = records.sparkSession.range(1).select(*[F.xxhash64(F.lit(s)) for s in shapes]).first()
    return list(row)


def unknown_layouts(records: DataFrame, body: str = "body", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(shape, n) of the records that no mapping reads."""
    known = [s for layout in layouts for s in layout.shapes()]
    return records.select(shape(col(body)).alias("shape")).filter(F.col("shape").isNull() | ~F.col("shape").isin(known)).groupBy("shape").agg(F.count("*").alias("n"))


# the template

def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(?=\\*(?:{CONTROL_ANGLE}))|\[(?=\\*{CONTROL_SQUARE})", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<)\\(?=\\*(?:{CONTROL_ANGLE}))|(\[)\\(?=\\*{CONTROL_SQUARE})", "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from canonical turns, ordered by turn (null first),
    role and text. ``loss_spans`` are the code points of the assistant's escaped texts,
    end exclusive. A conversation is one value of the result, so one task writes it."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = turns.select(
        "conv_id", "turn", "role", "text", F.when(F.col("role").isNotNull(), head).otherwise("").alias("_head"),
        F.when(F.col("role").isNotNull(), F.concat(body, F.lit(END))).otherwise("").alias("_rest"), F.length(body).alias("_body"),
    )
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "conv_id", "role", "_head", "_rest", "_body", F.row_number().over(whole).alias("_n"),
        F.coalesce(F.sum(F.length("_head") + F.length("_rest")).over(before), F.lit(0)).alias("_at"),
    )
    start = F.col("_at") + F.length("_head")
    rows = F.sort_array(F.collect_list(F.struct(
        "_n", F.concat("_head", "_rest").alias("piece"),
        F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.col("_body")).alias("end"))).alias("loss"),
    )))
    return placed.groupBy("conv_id").agg(rows.alias("_rows")).select(
        "conv_id", F.array_join(F.transform("_rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("_rows", lambda r: r["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.array_remove(F.split(formatted, r"<\|im_end\|>\n"), "")
    def turn(p):
        rest = F.substr(p, F.lit(len(START) + 1))
        return F.struct(
            unescape_role(F.substring_index(rest, "\n", 1)).alias("role"),
            unescape(F.substr(rest, F.locate("\n", rest) + 1)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_records(records: DataFrame, key: str = "conv_id", body: str = "body") -> DataFrame:
    """(conv_id, formatted, loss_spans) of heterogeneous records.

    Defined cases: a null role or text is empty; a null turn comes first; equal turns are
    ordered by role and text, and repeated ones stay; rows with a null conversation are
    one conversation; an unknown layout gives a conversation with an empty text; an
    empty table gives no rows; columns beside key and body are ignored.
    """
    return format_turns(canonical_turns(records, key, body))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars of every conversation."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def turn_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, body): every row of a table of turns as a record of its own."""
    return conversations.select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("body"))


def probe_records(spark) -> DataFrame:
    """Conversation -1, a prompt and a response that hold control strings."""
    return spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.parse_json(F.lit(f'{{"prompt": "{PROBE}", "response": "{PROBE}"}}')).alias("body")
    )


def _escaped_sql(text: str) -> str:
    inner = f"regexp_replace({text}, '(<)(\\\\*)({CONTROL_ANGLE})', '\\1\\\\\\2\\3', 'g')"
    return f"regexp_replace({inner}, '(\\[)(\\\\*)({CONTROL_SQUARE})', '\\1\\\\\\2\\3', 'g')"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')) AS v),
e AS (SELECT *, {len(START) + len(END) + 1} + length({_escaped_sql("replace(replace(r, '%', '%25'), chr(10), '%0A')")})
                + length({_escaped_sql('t')}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
