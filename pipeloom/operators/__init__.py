"""The operators of a pipe. Importing this package registers them."""

from pipeloom.operators import aggregation, control, host, joins, quality, reshape, rows, sets, shape, sheet, times  # noqa: F401
from pipeloom.operators.registry import OPERATORS, register  # noqa: F401
