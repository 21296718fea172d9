"""Plan guards for every registered query: no nested-loop or cartesian joins,
no row-at-a-time Python UDF (only Arrow-batched Python stages), and nothing
brought into one task but aggregates and small literal lists."""

import re

from corpusmill.plans import catalog

from .conftest import SF_SMALL

FORBIDDEN = r"BroadcastNestedLoopJoin|CartesianProduct|BatchEvalPython|TakeOrderedAndProject"
# what may stand under an exchange to one partition
REDUCED = r"HashAggregate|SortAggregate|ObjectHashAggregate|LocalTableScan|Scan ExistingRDD"


def _single_partition_inputs(plan: str) -> list[str]:
    """The first operator with rows of its own below each single-partition
    exchange."""
    lines = [x for x in plan.splitlines() if re.match(r"[\s:]*[+:]- ", x)]  # literals may hold line ends
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = (re.sub(r"^[\s:+\-*()0-9]*", "", x) for x in lines[i + 1:])
            out.append(next(x for x in below if not re.match(r"(Project|Filter|Sort|Window|AQEShuffleRead|ColumnarToRow|Generate)\b", x)))
    return out


def test_no_forbidden_operators(spark):
    bad = {}
    for key, fn in catalog.QUERIES.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        found = sorted(set(re.findall(FORBIDDEN, plan)))
        found += [x[:80] for x in _single_partition_inputs(plan) if not re.match(REDUCED, x)]
        if found:
            bad[key] = found
    assert bad == {}
