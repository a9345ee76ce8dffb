"""Composed jobs and the means that iterative jobs share."""
