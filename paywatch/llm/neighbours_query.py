"""Query of the nearest-neighbour search."""

from paywatch.llm import neighbours
from paywatch.llm.common import table
from paywatch.llm.registry import query

DIVISOR = 20


@query("op8_nearest")
def nearest_all(spark, folder):
    """The 20 nearest rows of every query row."""
    return neighbours.nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"), DIVISOR, 20)
