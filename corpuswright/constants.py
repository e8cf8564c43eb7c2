"""Fixed values shared by every stage."""

# Special tokens; the position in this list is the token id.
SPECIAL_TOKENS = ["<PAD>", "<MASK>", "<BOS>", "<EOS>", "<SEP>", "<UNK>"]

PAD, MASK, BOS, EOS, SEP, UNK = range(6)

# Ids that are never selected for masking and never scored.
PROTECTED_IDS = (PAD, SEP, BOS)

# Label value that losses and metrics skip.
IGNORE = -100

# Default settings.
VOCAB_SIZE = 30522
MIN_FREQUENCY = 2
MAX_SENTENCE_LENGTH = 128
MAX_SENTENCES = 128
MAX_LENGTH = 128
CHUNK_LENGTH = 128
MASK_PROBABILITY = 0.15
REPLACE_PROBABILITY = 0.85
DISCRIMINATOR_FACTOR = 50.0
