"""An extension: the analysis of documents as they arrive.  Every branch works on a document alone, so nothing is kept between them."""
