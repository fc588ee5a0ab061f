"""Classifiers, the window detector and the experiment grid."""
