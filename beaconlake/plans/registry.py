"""Every registered query by operator id, and its SQL twin where one exists."""
QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


from beaconlake.plans import (  # noqa: E402,F401
    q_columns, q_profiles, q_trends, q_sources, q_sets, q_vectors, q_ranking, q_state, q_rollups)
