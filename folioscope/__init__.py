"""Spark jobs over a corpus of notes, web pages and documents.

Every public operator takes DataFrames and returns a DataFrame; nothing in the
package collects a data-sized result to the driver.
"""
