"""quillgraph: multi-hop graph retrieval and text analytics as DataFrame plans."""

from quillgraph.api import AblationEvaluator, AnswerAgent, GraphLoader, Retriever, RunResult
from quillgraph.operators.retrieve import Retrieval, Settings

__all__ = ["AblationEvaluator", "AnswerAgent", "GraphLoader", "Retrieval", "Retriever", "RunResult", "Settings"]
