"""Column functions. What Spark's own expressions can say is said by them and stays in the JVM; the rest are kernels in
Arrow-batched UDFs, which get null for the rows that do not need them."""

from __future__ import annotations

from lettermill.functions.addresses import *  # noqa: F403
from lettermill.functions.messages import *  # noqa: F403
