"""Operators for preparing training data: names, sentences, splitting, consensus, copies, encoding, packing, subjects. Nothing outside imports them."""
