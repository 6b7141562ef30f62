"""The corpus pipeline: its stages, their SQL, and the run over all of them; see parley.llm.pipeline."""

from parley.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
