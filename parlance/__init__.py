"""parlance: question-answering text analytics as Spark DataFrame jobs.

Tables of answer phrases, intents, emotion-labelled questions, synonyms,
stop words and options are cleaned, filtered, de-duplicated and balanced;
classifiers are trained and applied relationally; answers are ranked per
question in batch or on a Structured Streaming source.
"""

__version__ = "0.1.0"
