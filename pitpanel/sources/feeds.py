"""Semi-structured line feeds to rows: nested JSON and pasted board text.

One bad element costs only itself; nothing raises on hostile input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pitpanel.functions.names import person_like
from pitpanel.functions.prob import finite_number
from pitpanel.operators.ordered import fenced

LINE_COLUMNS = ["name", "team", "position", "stat_type", "line", "start_time", "direction", "odds_type"]

# Feed restriction -> offered side.
WAGER_SIDE = {"over": "more", "under": "less"}

# Markers glued to the end of a stat label.
MARKERS = {"Demon": "\ufffe", "Goblin": "\uffff"}
ESCAPE = "\ufffd"

# Line breaks, a group-and-position line, a number line, button labels.
_BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_TEAM_POS = r"^[A-Z]{2,4}\s*-\s*[A-Za-z0-9]{1,3}$"
_NUMBER = r"^\d+(\.\d+)?$"
_BUTTONS = ("Less", "More")

_ENVELOPE = "data array<string>, included array<string>, _bad string"
_PROJECTION = (
    "type string, attributes struct<stat_type string, stat_display_name string, line_score string, "
    "odds_type string, description string, start_time string, allowed_wager_types string>, "
    "relationships struct<new_player struct<data struct<id string>>>"
)
_PLAYER = (
    "type string, id string, attributes struct<name string, display_name string, team string, "
    "team_name string, position string>"
)


def offered_by_feed(raw: Column) -> Column:
    """Sides a feed row allows: absent means both, an unknown word means both."""
    items = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    words = F.transform(items, lambda w: F.lower(F.trim(w)))
    known = F.forall(words, lambda w: F.coalesce(w.isin(list(WAGER_SIDE)), F.lit(False)))
    over, under = F.array_contains(words, "over"), F.array_contains(words, "under")
    return (
        F.when(raw.isNull() | ~F.coalesce(known, F.lit(False)), "both")
        .when(over & ~under, WAGER_SIDE["over"])
        .when(under & ~over, WAGER_SIDE["under"])
        .otherwise("both")
    )


def strip_markers(label: Column) -> Column:
    """Drop every trailing marker in linear time: stand-ins, a trim, and back.

    Stand-ins that the label itself holds are escaped first, and so is the escape character.
    """
    escaped = [ESCAPE, *MARKERS.values()]
    s = label
    for n, c in enumerate(escaped):
        s = F.replace(s, F.lit(c), F.lit(f"{ESCAPE}{n}"))
    for word, stand_in in MARKERS.items():
        s = F.replace(s, F.lit(word), F.lit(stand_in))
    s = F.rtrim(s, F.lit("".join(MARKERS.values())))
    for word, stand_in in MARKERS.items():
        s = F.replace(s, F.lit(stand_in), F.lit(word))
    for n, c in reversed(list(enumerate(escaped))):
        s = F.replace(s, F.lit(f"{ESCAPE}{n}"), F.lit(c))
    return s


def json_envelope(text: Column) -> Column:
    return F.from_json(text, _ENVELOPE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})


def parse_json(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every projection of every document: the line columns, pos and reject_reason (null when kept).

    Projections and players are exploded together, so each document is read once; a player record
    reaches its projections inside (document, player).
    """
    env = fenced(docs.select(doc_id, text), e=json_envelope(F.col(text)))
    parts = F.concat(
        F.transform(
            F.coalesce("e.data", F.array().cast("array<string>")),
            lambda r, i: F.struct(i.alias("pos"), F.from_json(r, _PROJECTION).alias("p"), F.lit(None).cast(_struct(_PLAYER)).alias("w")),
        ),
        F.transform(
            F.coalesce("e.included", F.array().cast("array<string>")),
            lambda r, i: F.struct(i.alias("pos"), F.lit(None).cast(_struct(_PROJECTION)).alias("p"), F.from_json(r, _PLAYER).alias("w")),
        ),
    )
    x = env.select(doc_id, F.inline(parts))
    is_line = F.col("p.type") == "projection"
    is_player = F.col("w.type").isin("new_player", "player")
    b = F.col("w.attributes")
    who = F.struct(
        F.coalesce(F.nullif(b["name"], F.lit("")), b["display_name"]).alias("name"),
        F.coalesce(F.nullif(b["team"], F.lit("")), b["team_name"]).alias("team"),
        b["position"].alias("position"),
    )
    keyed = x.where(is_line | is_player).select(
        doc_id, "pos", "p", is_line.alias("is_line"), F.when(is_player, who).alias("who"),
        F.coalesce(F.when(is_line, F.col("p.relationships.new_player.data.id")).otherwise(F.col("w.id")), F.lit("")).alias("pid"),
    )
    # The last player record of an id wins; a group is part of one document.
    group = Window.partitionBy(doc_id, "pid")
    known = F.max_by("who", F.when(F.col("who").isNotNull(), F.col("pos"))).over(group)
    j = keyed.withColumn("w", known).where("is_line")
    a = F.col("p.attributes")
    named = F.nullif(F.col("w.name"), F.lit(""))
    name = F.coalesce(named, F.when(person_like(a["description"]), a["description"]))
    line = finite_number(a["line_score"])
    return j.select(
        doc_id, "pos", name.alias("name"), F.col("w.team").alias("team"), F.col("w.position").alias("position"),
        F.coalesce(F.nullif(a["stat_type"], F.lit("")), a["stat_display_name"]).alias("stat_type"),
        line.alias("line"), a["start_time"].alias("start_time"),
        offered_by_feed(a["allowed_wager_types"]).alias("direction"),
        F.lower(F.coalesce(F.nullif(a["odds_type"], F.lit("")), F.lit("standard"))).alias("odds_type"),
        F.when(a["line_score"].isNull() | name.isNull(), "no_name")
        .when(line.isNull(), "bad_line")
        .alias("reject_reason"),
    )


def _struct(fields: str) -> T.StructType:
    return T.StructType.fromDDL(fields)


def board_lines(text: Column) -> Column:
    """Trimmed non-empty lines of a text."""
    cut = F.transform(F.split(text, _BREAKS), lambda s: F.regexp_replace(s, r"^(?U:\s+)|(?U:\s+)$", ""))
    return F.filter(cut, lambda s: F.length(s) > 0)


def _at(lines: Column, i: Column) -> Column:
    """Zero-based element, null past the end."""
    return F.try_element_at(lines, (i + 1).cast("int"))


#: Candidate starts that are resolved together.
BOARD_BLOCK = 64


def parse_board(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Board text to line rows, one document per row, without a shuffle.

    A record is a person-like line, an optional "TEAM - POS" line, a number, a stat label and any
    Less / More buttons. A start inside an earlier record is not a start.
    """
    base = fenced(docs.select(doc_id, text), L=board_lines(F.col(text))).where(F.size("L") >= 3)
    L = F.col("L")
    base = fenced(
        base.select(doc_id, "L"),
        number=F.transform(L, lambda s: s.rlike(_NUMBER)),
        team_line=F.transform(L, lambda s: s.rlike(_TEAM_POS)),
    )

    def has_team(i):
        return F.coalesce(_at(F.col("team_line"), i + 1), F.lit(False))

    def number_at(i):
        return i + 1 + has_team(i).cast("int")

    def starts(i):
        n = number_at(i)
        numbered = F.coalesce(_at(F.col("number"), n), F.lit(False)) & _at(L, n + 1).isNotNull()
        return numbered & person_like(_at(L, i))

    cands = F.filter(F.sequence(F.lit(0), F.size(L) - 3), starts)
    # A record is at most four lines, so a block of candidates can be entered in four ways only: with its first 0, 1, 2 or 3
    # lines taken. Each block's four outcomes are worked out by themselves, the blocks are chained, and then each is resolved
    # from the way it was entered: no array grows with the text, and the time is linear in its lines.
    after = lambda free, i: F.when(i < free, free).otherwise(number_at(i) + 2)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("C") - 1) / BOARD_BLOCK).cast("int")), lambda k: F.slice("C", k * BOARD_BLOCK + 1, F.lit(BOARD_BLOCK)))
    outcomes = lambda block: F.array(*[F.aggregate(block, block[0] + F.lit(s), after) for s in range(4)])
    base = fenced(base, C=cands).where(F.size("C") > 0)
    base = fenced(base, B=blocks)
    base = fenced(base, O=F.transform("B", outcomes))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("ways"))
    ways = F.aggregate(
        F.sequence(F.lit(0), F.size("B") - 1), start,
        lambda acc, k: F.struct(
            F.col("O")[k][F.greatest(F.lit(0), acc["free"] - F.col("B")[k][0])].alias("free"),
            F.array_append(acc["ways"], F.greatest(F.lit(0), acc["free"] - F.col("B")[k][0])).alias("ways"),
        ),
        lambda acc: acc["ways"],
    )
    base = fenced(base, W=ways)

    def resolved(block, way):
        none = F.struct((block[0] + way).alias("free"), F.array().cast("array<int>").alias("kept"))
        return F.aggregate(
            block, none,
            lambda acc, i: F.when(i < acc["free"], acc).otherwise(F.struct((number_at(i) + 2).alias("free"), F.array_append(acc["kept"], i).alias("kept"))),
            lambda acc: acc["kept"],
        )

    kept = F.flatten(F.zip_with("B", "W", resolved))
    def record(i):
        n = number_at(i)
        team_pos = F.when(n == i + 2, _at(L, i + 1))
        label = _at(L, n + 1)
        near = F.slice(L, n + 3, F.lit(3))
        # Three buttons in a row is unusual; only then is the whole remaining run read.
        behind = F.when(
            F.forall(near, lambda s: s.isin(*_BUTTONS)) & (F.size(near) == 3),
            F.slice(L, n + 3, F.size(L)),
        ).otherwise(near)
        stop = F.array_position(F.transform(behind, lambda s: s.isin(*_BUTTONS)), False)
        run = F.when(stop > 0, F.slice(behind, F.lit(1), (stop - 1).cast("int"))).otherwise(behind)
        return F.struct(
            i.alias("pos"), _at(L, i).alias("name"), team_pos.alias("__team"), label.alias("__label"), _at(L, n).alias("__line"),
            F.array_contains(run, "Less").alias("__less"), F.array_contains(run, "More").alias("__more"),
        )

    # Records are built before they become rows: a row must not carry the whole text.
    rows = base.select(doc_id, F.inline(F.transform(kept, record)))
    team_pos, label, less, more = F.col("__team"), F.col("__label"), F.col("__less"), F.col("__more")
    return rows.select(
        doc_id, "pos", "name",
        F.regexp_extract(team_pos, r"^([A-Z]{2,4})\s*-", 1).alias("team"),
        F.regexp_extract(team_pos, r"-\s*([A-Za-z0-9]{1,3})$", 1).alias("position"),
        F.trim(strip_markers(label)).alias("stat_type"),
        F.col("__line").cast("double").alias("line"),
        F.lit(None).cast("string").alias("start_time"),
        F.when(less & more, "both").when(more, "more").when(less, "less").otherwise("").alias("direction"),
        F.when(F.contains(label, F.lit("Demon")), "demon")
        .when(F.contains(label, F.lit("Goblin")), "goblin")
        .otherwise("standard")
        .alias("odds_type"),
        F.lit(None).cast("string").alias("reject_reason"),
    )


def parse_any(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Route each document by shape; text that claims to be JSON but is not goes to the board parser."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^(?U:\s+)", "")
    t = F.col("__t")
    opens = F.startswith(t, F.lit("{"))
    readable = F.when(opens, json_envelope(t)["_bad"].isNull()).otherwise(F.lit(False))
    listed = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>").isNotNull()).otherwise(F.lit(False))
    tagged = fenced(docs.select(doc_id, trimmed.alias("__t")), __json=readable, __array=listed)
    as_json = parse_json(tagged.where("__json"), doc_id, "__t")
    as_text = parse_board(tagged.where("NOT __json AND NOT __array"), doc_id, "__t")
    return as_json.unionByName(as_text)


def snapshot_props(snapshots: DataFrame, scraped: str, payload: str) -> DataFrame:
    """History of snapshot files to one row per (snapshot, prop); unreadable rows drop out alone."""
    props = F.from_json(F.col(payload), "props array<string>")["props"]
    schema = "player string, stat string, line string, startTimeIso string, start_time string"
    p = F.from_json("raw", schema)
    rows = snapshots.select(F.col(scraped), F.explode(props).alias("raw")).select(scraped, p.alias("p"))
    when = F.coalesce("p.startTimeIso", "p.start_time")
    return rows.select(
        F.col(scraped).try_cast("timestamp").alias("scraped_at"),
        F.col("p.player").alias("player"),
        F.col("p.stat").alias("stat"),
        finite_number(F.col("p.line")).alias("line"),
        when.try_cast("timestamp").alias("start_at"),
    ).where(F.col("scraped_at").isNotNull() & F.col("start_at").isNotNull())
