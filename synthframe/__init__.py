"""Synthesis and scoring of tabular data on Spark."""

from synthframe.operators.profile import profile_frame
from synthframe.operators.quality import column_shapes, pair_trends, quality_score
from synthframe.plans.synthesizer import PRESETS, FittedModel, Synthesizer
from synthframe.session import local_session, tune

__all__ = ["PRESETS", "FittedModel", "Synthesizer", "column_shapes", "local_session", "pair_trends", "profile_frame",
           "quality_score", "tune"]
