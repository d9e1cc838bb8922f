"""Query plans bound to the driver tables; importing registers them."""
from . import q_bias, q_detail, q_entities, q_more, q_rows, q_serving, q_similarity, q_text, q_writes  # noqa: F401
from .registry import REGISTRY  # noqa: F401
