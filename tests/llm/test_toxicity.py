"""Every term of the training rows has a weight."""

import numpy as np
import pyarrow as pa

from quern.llm import toxicity


def test_all_terms_have_weights():
    # 400 insults of one row each: more than a short list holds, and none frequent
    texts = [f"plain words here number{i}" for i in range(400)] + [f"plain words here zq{i}insult" for i in range(400)]
    machine = toxicity.Machine(texts, np.repeat([0, 1], 400), 0.5)
    data, offs = toxicity.X.buffers(pa.array(texts))
    assert (machine.slot[toxicity.terms(data, offs)[0]] > 0).all()
    scores = machine.score(data, offs)
    assert scores[400:].min() > scores[:400].max()
