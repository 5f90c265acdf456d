"""All registered queries and their SQL."""

from . import q_batch, q_codec, q_decode, q_domain, q_engine, q_speech, q_text  # noqa: F401
from .views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
