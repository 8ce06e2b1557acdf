"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.collocations import OP12_SQL, op12_era_collocations
from driftwell.llm.context_tree import op6_context_tree_weighting
from driftwell.llm.decontaminate import OP7_SQL, op7_winnowing_decontamination
from driftwell.llm.filter_audit import OP11_SQL, op11_filter_interactions
from driftwell.llm.hyperplanes import OP13_SQL, op13_hyperplane_near_dedup
from driftwell.llm.line_spread import OP10_SQL, op10_distinct_site_spread
from driftwell.llm.mixing import OP4_SQL, op4_curriculum_mix
from driftwell.llm.simhash import op5_pivot_simhash
from driftwell.llm.quality_fm import op9_factorisation_machine
from driftwell.llm.quality_rules import op8_tokeniser_fertility
from driftwell.llm.secrets import op1_linked_credentials
from driftwell.llm.sharding import op2_sampled_splitters
from driftwell.llm.wrappers import op3_union_free_wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_linked_credentials, op2_sampled_splitters, op3_union_free_wrappers, op4_curriculum_mix, op5_pivot_simhash, op6_context_tree_weighting, op7_winnowing_decontamination, op8_tokeniser_fertility, op9_factorisation_machine, op10_distinct_site_spread, op11_filter_interactions, op12_era_collocations, op13_hyperplane_near_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_curriculum_mix": OP4_SQL, "op7_winnowing_decontamination": OP7_SQL, "op10_distinct_site_spread": OP10_SQL, "op11_filter_interactions": OP11_SQL, "op12_era_collocations": OP12_SQL, "op13_hyperplane_near_dedup": OP13_SQL}
