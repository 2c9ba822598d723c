"""The registered query of each operator of this subpackage, and its SQL where SQL can say it."""
QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add



from beaconlake.llm import q_alignment, q_lines, q_mixing, q_ngrams, q_passages, q_personal, q_quality, q_rules, q_shards, q_tokens, q_turns, q_urls, q_vectors  # noqa: E402,F401
