"""The registered queries of the folder and their SQL belong together."""

import __spark_entry__ as entry
from logrisk.llm import oracle, queries


def test_names():
    names = {f"op{n}_" for n in range(1, 11)}
    found = {next(p for p in names if name.startswith(p)) for name in queries.REGISTERED}
    assert found == names and len(queries.REGISTERED) == 10
    assert set(oracle.SQL) <= set(queries.REGISTERED)
    assert set(queries.REGISTERED) | {"pipeline"} <= set(entry.queries())
