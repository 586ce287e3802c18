"""Operators of a training-data pipeline.  Importing ``queries`` gives their named queries; nothing else imports this package."""
