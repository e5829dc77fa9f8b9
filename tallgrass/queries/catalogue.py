"""All queries outside the subpackage for training data."""

from __future__ import annotations

from tallgrass.queries import masterdata, quality

FLAGSHIP = "scorecard_by_dimension"

QUERIES = {**masterdata.QUERIES, **quality.QUERIES}
