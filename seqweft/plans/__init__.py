"""Registered queries, grouped as in the operator inventory."""

from importlib import import_module

GROUPS = [
    "sequence_queries",
    "window_queries",
    "signal_queries",
    "scan_queries",
    "column_queries",
    "join_queries",
    "profile_queries",
    "transform_queries",
    "evaluation_queries",
    "trial_queries",
    "streaming_queries",
    "flow_queries",
]


def load_all() -> None:
    for name in GROUPS:
        import_module(f"seqweft.plans.{name}")
