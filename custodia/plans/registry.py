"""Registered queries: one DataFrame builder each, and its SQL where there is one."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
