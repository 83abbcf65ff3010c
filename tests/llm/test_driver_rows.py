"""What the operators of this package may bring to the driver."""

import re
from pathlib import Path

from ledgerloom.llm import decontaminate, lm

# decontaminate: lengths of short windows (under WINDOW numbers) and SLICE fingerprints at a time;
# lm: words with over 1 / (heavy * shards) of all tokens, so at most heavy * shards, and their numbers of successors.
BOUNDED = {"decontaminate.py": 2, "lm.py": 2}


def test_calls_that_gather_rows_are_the_bounded_ones():
    found = {}
    for path in Path(lm.__file__).parent.glob("*.py"):
        code = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|toPandas\(|toLocalIterator|toArrow\(", code), path
        if n := code.count(".collect()"):
            found[path.name] = n
    assert found == BOUNDED
    assert decontaminate.WINDOW <= 10 and decontaminate.SLICE <= 4_000_000
