"""Edit commands on scene objects, as joins: of commands on one field of an object the last one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {"update_annotation_text": "text", "set_symbol_type": "symbol_id", "set_symbol_rotation": "rotation", "set_layer": "layer_id"}


def applied(objects: DataFrame, commands: DataFrame, ident: str = "id") -> DataFrame:
    """Objects after commands (object_id, seq, type, value): edited fields take the last value, and edited objects are confirmed.

    Commands on unknown objects change nothing; `unknown_targets` lists them.
    """
    last = commands.groupBy(F.col("object_id").alias(ident)).agg(*[F.max_by(F.when(F.col("type") == kind, F.col("value")), F.when(F.col("type") == kind, F.col("seq"))).alias(f"_{field}") for kind, field in FIELDS.items()])
    met = objects.join(last.withColumn("_edited", F.lit(True)), ident, "left")
    fields = {field: F.coalesce(F.col(f"_{field}").cast(objects.schema[field].dataType), F.col(field)) for field in FIELDS.values() if field in objects.columns}
    made = met.withColumns(fields).withColumn("state", F.when(F.col("_edited"), "confirmed").otherwise(F.col("state")))
    return made.select(*objects.columns)


def unknown_targets(objects: DataFrame, commands: DataFrame, ident: str = "id") -> DataFrame:
    return commands.join(objects.select(F.col(ident).alias("object_id")), "object_id", "left_anti")


def moved_junctions(junctions: DataFrame, pipes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(junctions, pipes) after moves (junction_id, seq, x, y): the ends of pipes follow their junctions."""
    last = moves.groupBy("junction_id").agg(F.max_by(F.struct("x", "y"), "seq").alias("to"))
    at = junctions.join(last.select(F.col("junction_id").alias("id"), "to"), "id", "left")
    junctions = at.select(*[F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c) if c in ("x", "y") else F.col(c) for c in junctions.columns])
    out = pipes
    for k, node in ((0, "start_node"), (1, "end_node")):
        met = out.join(last.select(F.col("junction_id").alias(node), F.col("to").alias("_to")), node, "left")
        out = met.select(*[F.coalesce(F.col(f"_to.{c[0]}"), F.col(c)).alias(c) if c in (f"x{k}", f"y{k}") else F.col(c) for c in pipes.columns])
    return junctions, out


def connected_pipes(pipes: DataFrame, junctions: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pipes, new junctions, rejected commands) after commands (pipe_id, end: start or end, seq, node_id) on ends of pipes.

    A node connects the end and moves it there, null disconnects it where it lies, onto a new junction whose id follows
    from pipe, end and seq. Of commands on one end the last counts; pipes and nodes that don't exist are rejected.
    """
    at = junctions.select(F.col("id").alias("node_id"), F.struct("x", "y").alias("_at"))
    met = commands.join(pipes.select(F.col("id").alias("pipe_id"), F.lit(True).alias("_pipe")), "pipe_id", "left").join(at, "node_id", "left")
    wrong = F.col("_pipe").isNull() | (F.col("node_id").isNotNull() & F.col("_at").isNull())
    new = F.concat_ws("-", F.lit("cut"), F.col("pipe_id").cast("string"), "end", F.col("seq").cast("string"))
    good = met.where(~wrong).withColumn("_node", F.coalesce(F.col("node_id").cast("string"), new))
    last = good.groupBy("pipe_id", "end").agg(F.max_by(F.struct(F.col("_node").alias("node"), F.col("node_id").isNull().alias("cut")), "seq").alias("to"), F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col("seq"))).alias("_xy"))
    out = pipes.withColumn("_cuts", F.array().cast("array<struct<id:string,x:double,y:double>>"))
    names = [f.name for f in pipes.schema]
    for k, end in ((0, "start"), (1, "end")):
        own = last.where(F.col("end") == end).select(F.col("pipe_id").alias("id"), "to", "_xy")
        out = out.join(own, "id", "left")
        edited = F.col("to").isNotNull()
        out = out.withColumns({f"{end}_node": F.coalesce("to.node", f"{end}_node"), f"x{k}": F.coalesce("_xy.x", f"x{k}"), f"y{k}": F.coalesce("_xy.y", f"y{k}"), "state": F.when(edited, "confirmed").otherwise(F.col("state"))})
        cut = F.array(F.struct(F.col("to.node").alias("id"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")))
        out = out.withColumn("_cuts", F.when(F.col("to.cut"), F.concat("_cuts", cut)).otherwise(F.col("_cuts"))).drop("to", "_xy")
    created = out.select(F.explode("_cuts").alias("c")).select("c.id", "c.x", "c.y")
    return out.select(*names), created, met.where(wrong).select("pipe_id", "end", "seq", "node_id")


def last_values(rows: DataFrame, commands: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows whose `values` take those of the last command (key, seq, values), null included; `edited` tells which."""
    last = commands.groupBy(*key).agg(F.max_by(F.struct(*values), "seq").alias("_to"))
    met = rows.join(last, key, "left")
    edited = F.col("_to").isNotNull()
    return met.select(*[F.when(edited, F.col(f"_to.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns], edited.alias("edited"))


#: Commands on one object: the type of object that each is for, and what it sets. Fixed values.
COMMANDS = {
    "update_annotation_text": ("annotation", ("text",)), "move_annotation": ("annotation", ("x", "y")), "set_symbol_type": ("symbol", ("symbol_id",)),
    "set_symbol_rotation": ("symbol", ("rotation",)), "move_junction": ("junction", ("x", "y")), "set_dimension_text": ("dimension", ("display_text",)),
}
#: Each field's place in a command.
_SOURCES = {"text": "value", "symbol_id": "value", "display_text": "value", "rotation": "number", "x": "x", "y": "y"}


def command_problems(objects: DataFrame, commands: DataFrame, page: str = "document_id") -> DataFrame:
    """Commands (page, object_id, seq, type, value, number, x, y) that can't be applied, with problem: unknown_command, unknown_object, wrong_type or bad_value."""
    wanted = F.coalesce(*[F.when(F.col("type") == kind, F.lit(target)) for kind, (target, _) in COMMANDS.items()])
    known = objects.select(page, F.col("id").alias("object_id"), F.col("type").alias("_own"))
    met = commands.join(known, [page, "object_id"], "left").withColumn("_wanted", wanted)
    no = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    moves = F.col("type").isin("move_annotation", "move_junction")
    texts = F.col("type").isin("update_annotation_text", "set_symbol_type", "set_dimension_text")
    bad = (moves & (no("x") | no("y"))) | ((F.col("type") == "set_symbol_rotation") & no("number")) | (texts & F.col("value").isNull())
    problem = (
        F.when(F.col("_wanted").isNull(), "unknown_command").when(F.col("_own").isNull(), "unknown_object")
        .when(F.col("_own") != F.col("_wanted"), "wrong_type").when(bad, "bad_value")
    )
    return met.select(page, "object_id", "seq", "type", problem.alias("problem")).where("problem is not null")


def edited_scenes(objects: DataFrame, commands: DataFrame, page: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(objects, problems) after the commands of each document in order of seq, all of them or - if one can't be applied - none.

    Of commands that set one field of an object the last counts. Edited objects are confirmed and keep their score. objects has
    edited, whether a command met it; the ends of pipes follow their junctions by `moved_junctions`.
    """
    problems = command_problems(objects, commands, page)
    good = commands.join(problems.select(page).distinct(), page, "left_anti")
    setters = {}
    for kind, (_, names) in COMMANDS.items():
        for name in names:
            setters.setdefault(name, []).append(kind)
    sums = [F.max_by(F.when(F.col("type").isin(*kinds), F.col(_SOURCES[name])), F.when(F.col("type").isin(*kinds), F.col("seq"))).alias(f"_{name}") for name, kinds in setters.items()]
    last = good.groupBy(page, F.col("object_id").alias("id")).agg(*sums, F.lit(True).alias("_edited"))
    met = objects.join(last, [page, "id"], "left")
    values = {name: F.coalesce(F.col(f"_{name}").cast(objects.schema[name].dataType), F.col(name)) for name in setters}
    edited = F.coalesce("_edited", F.lit(False))
    made = met.withColumns(values).withColumn("state", F.when(edited, "confirmed").otherwise(F.col("state")))
    return made.select(*objects.columns, edited.alias("edited")), problems


def scene_problems(objects: DataFrame, page: str = "document_id") -> DataFrame:
    """page, id and problem of objects that no edit may leave behind: not_finite or outside for places, blank for texts and symbols without a type."""
    no = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") > F.col("page_width")) | (F.col("y") > F.col("page_height"))
    blank = ((F.col("type") == "annotation") & (F.trim("text") == "")) | ((F.col("type") == "symbol") & (F.trim("symbol_id") == ""))
    problem = F.when(no("x") | no("y") | no("rotation"), "not_finite").when(outside, "outside").when(blank, "blank")
    return objects.select(page, "id", problem.alias("problem")).where("problem is not null")
