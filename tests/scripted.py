"""A transformer double."""


class ScriptedTransformer:
    """Test transformer: per sample a list of answers consumed in call order;
    an Exception instance is raised instead of returned."""

    def __init__(self, script: dict[int, list]):
        self.script = script

    def __call__(self, request):
        seq = self.script.get(request["sample_id"], [])
        idx = request["attempt"] * 2 + (1 if request["kind"] == "focus" else 0)
        answer = seq[idx] if idx < len(seq) else None
        if isinstance(answer, Exception):
            raise answer
        return answer
