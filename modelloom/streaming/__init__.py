from modelloom.streaming.score import score_stream

__all__ = ["score_stream"]
