"""Operators for preparing language-model training data.

Nothing outside this folder imports it; removing it leaves the rest of the
package working.
"""
