"""Spark-native incremental materialization engine."""

from .api import Axis, Dependencies, Graph, Outputs, Pipeline, Stage, batch_stage, matrix, stage

__all__ = ["Axis", "Dependencies", "Graph", "Outputs", "Pipeline", "Stage", "batch_stage", "matrix", "stage"]
__version__ = "0.1.0"
