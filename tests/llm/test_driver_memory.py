"""The pipeline's check: the driver learns within its memory."""

import numpy as np

from newslink.llm import crf, langid


def test_batches_of_a_training_are_held_in_few_bytes():
    words = crf.Words(["rain falls on the plain", "sonne scheint auf das feld"], **langid.FEATURES)
    assert words.features.dtype == np.int32 and words.owner.dtype == np.int32
    model = crf.train([(words, (words.doc == 1).astype(np.int64), np.ones(len(words.doc), np.float32))], ["a", "b"], langid.FEATURES, 5)
    assert (model.marginals(words).argmax(axis=1) == words.doc).all()
