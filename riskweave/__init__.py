"""Entity-risk features and models on Spark DataFrames.

The package turns coded events, measurements and free-text notes into one
sparse feature vector per entity, labels and splits the entities, trains
classifiers and reports their quality.  Every operator takes and returns
DataFrames; nothing runs until the caller asks for a result, except where a
function says that it writes a table or fits a model.
"""

__version__ = "0.1.0"
