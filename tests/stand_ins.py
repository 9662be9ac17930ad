"""Networks whose image bytes are the logits themselves, as float32 of shape (4, n, n)."""

import numpy as np


class StoredLogits:
    raw = True

    def load(self):
        pass

    def logits(self, image):
        flat = np.frombuffer(image, "<f4")
        n = int(round((len(flat) // 4) ** 0.5))
        return flat.reshape(4, n, n)


class Refusing(StoredLogits):
    """Fails for an image that holds no numbers."""

    def logits(self, image):
        found = super().logits(image)
        if np.isnan(found).any():
            raise ValueError("refused")
        return found


class Together(Refusing):
    """Takes many images; one that fails fails them all. Calls are counted."""

    def __init__(self, batch, calls):
        self.batch, self.calls = batch, calls

    def logits_of(self, images):
        self.calls.add(1)
        return np.stack([self.logits(bytes(x)) for x in images])
