"""quern: a Spark-native engine for building text datasets.

Sub-packages: ``functions`` (Column -> Column), ``operators`` (DataFrame ->
DataFrame), ``sources`` (readers and writers), ``plans`` (whole pipelines),
``streaming`` (incremental runs) and the optional ``llm`` (operators for
training data; nothing else imports it).
"""
