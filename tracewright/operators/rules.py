"""The catalogue of rewrite rules with their side conditions, the ids of transformation events, and what candidates say about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules by name, each with its side conditions.
RULES = {
    "remove_identity": "is_identity pure", "reduce_to_0": "pure", "undo_distributive": "pure", "sub_to_mult": "pure",
    "normalize_iteration_step": "no_writes pure", "loop_reversal_d2i": "no_writes pure", "loop_reversal_i2d": "no_writes pure",
    "loop_interchange": "no_rw pure", "loop_interchange_pragma": "no_rw pure", "for_chunk": "no_writes pure", "unrolling": "",
    "move_inside_for_pre": "all_are_decl no_writes no_writes_in_read", "move_inside_for_post": "all_are_decl no_writes pure",
    "move_enclosing_if_inside_for": "all_are_decl no_writes_in_read", "collapse_2_for_loops": "no_empty no_writes pure",
    "for_loop_fission": "no_empty no_reads_in_written no_writes", "for_loop_fusion_map_map": "has_calls no_reads_in_written no_writes not",
    "for_loop_fusion_map_zipWith": "has_calls no_reads_in_written no_writes not", "for_loop_fusion_zipWith_map": "has_calls no_reads_in_written no_writes not",
    "for_loop_fusion_zipWith_zipWith": "has_calls no_reads_in_written no_writes not", "for_loop_fusion": "has_calls no_reads_in_written no_rw no_writes not",
    "for_wo_block_2_for_w_block": "is_block not", "remove_empty_for": "pure", "for_to_while": "", "while_to_for": "",
    "if_wo_block_2_if_w_block": "is_block not", "if_wo_else_2_if_w_else": "", "split_addition_assign": "pure", "join_addition_assign": "pure",
    "mult_ternary_2_ternary": "pure", "sum_ternary_2_ternary": "pure", "assign_ternary_2_if_else": "pure", "if_else_2_assign_ternary": "pure",
    "if_2_assign_ternary": "pure", "empty_else": "", "remove_ternary": "pure", "remove_block": "", "remove_empty_if": "pure",
    "remove_useless_statement": "is_expr pure", "strength_reduction": "is_cons no_writes", "useless_assign": "pure", "replace_var_equal": "pure",
    "contiguous_same_if": "no_writes_in_read", "divide_if": "no_empty no_writes_in_read", "just_one_iteration_removal": "no_writes pure",
    "join_assignments": "no_writes_in_read pure", "propagate_assignment": "no_empty no_writes pure reads",
    "loop_inv_code_motion": "is_cons is_var no_reads not pure", "inlining": "has_calls", "inlining_assignment": "is_call",
    "common_subexp_elimination": "is_cons is_var not", "introduce_aux_array": "", "flatten_float_array": "", "flatten_int_array": "",
    "subs_struct_by_fields": "", "roll_up_init": "is_array is_rollable not", "roll_up": "is_array is_decl_in is_rollable lhs not",
    "roll_up_array_init": "is_array is_rollable", "roll_up_array": "is_array is_rollable", "feat_move_inside_for_pre": "no_writes", "feat_move_inside_for_post": "pure",
}

#: The first id of transformation events, the names in the order of their ids, and the values of start and end.
FIRST_ID = 1_000_000
TRANSFORMATIONS = (
    "remove_identity reduce_to_0 undo_distributive sub_to_mult normalize_iteration_step loop_reversal_d2i loop_reversal_i2d loop_interchange "
    "loop_interchange_pragma for_chunk unrolling move_inside_for collapse_2_for_loops for_loop_fission for_loop_fusion_mapmap for_loop_fusion "
    "for_wo_block_2_for_w_block remove_empty_for for_to_while while_to_for if_wo_block_2_if_w_block if_wo_else_2_if_w_else split_addition_assign "
    "join_addition_assign mult_ternary_2_ternary sum_ternary_2_ternary assign_ternary_2_if_else if_else_2_assign_ternary if_2_assign_ternary empty_else "
    "remove_ternary remove_block remove_empty_if remove_useless_statement strength_reduction useless_assign replace_var_equal just_one_iteration_removal "
    "join_assignments propagate_assignment loop_inv_code_motion inlining inlining_assignment common_subexp_elimination introduce_aux_array "
    "flatten_float_array flatten_int_array subs_struct_by_fields roll_up_init roll_up roll_up_array_init roll_up_array"
).split()
START, END = 1, 0


def rules(spark: SparkSession) -> DataFrame:
    """(rule, conditions): the catalogue."""
    return spark.createDataFrame([(n, c.split()) for n, c in RULES.items()], "rule string, conditions array<string>")


def transformations(spark: SparkSession) -> DataFrame:
    """(type, name): the ids of transformation events."""
    return spark.createDataFrame([(FIRST_ID + i, n) for i, n in enumerate(TRANSFORMATIONS)], "type int, name string")


def applicable(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rules of which all conditions hold at a place: found (place ..., holds array<string>), known (rule, conditions). The catalogue is fixed."""
    return found.crossJoin(F.broadcast(known)).where(F.size(F.array_except("conditions", "holds")) == 0).drop("conditions", "holds")


def transformation_intervals(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, t0, t1): transformation events (keys, time, seq, type, value) as intervals from a start to the next end of its type."""
    from pyspark.sql import Window

    own = events.join(F.broadcast(transformations(events.sparkSession)), "type")
    w = Window.partitionBy(*keys, "type").orderBy("time", "seq")
    marked = own.withColumn("_next", F.lead("value").over(w)).withColumn("t1", F.lead("time").over(w))
    return marked.where((F.col("value") == START) & (F.col("_next") == END)).select(*keys, "name", F.col("time").alias("t0"), "t1")


class Protocols:
    """User-defined online analyses by name: each is called with every batch of a stream, or with a whole table."""

    def __init__(self):
        self.known: dict[str, Callable[[DataFrame, int], None]] = {}

    def register(self, name: str, analyse: Callable[[DataFrame, int], None]) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = analyse

    def start(self, name: str, events: DataFrame, checkpoint: str):
        """The streaming query of a registered analysis."""
        return events.writeStream.foreachBatch(self.known[name]).option("checkpointLocation", checkpoint).start()
