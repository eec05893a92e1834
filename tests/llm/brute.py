"""What the operators must return, computed the plain way; rows are (doc_id, text), doc_ids are distinct and not null."""

import re,hashlib
from collections import defaultdict,Counter
W=re.compile(r'[^\x20\x09-\x0D]+')
WS="\x20\x09\x0a\x0b\x0c\x0d"
def low(t): return t.translate({i:i+32 for i in range(65,91)})
def lines(rows):
    ks=[(i,[low(l.strip(WS)) for l in (t or "").split("\n")],(t or "").split("\n")) for i,t in rows]
    docs=defaultdict(set)
    for i,k,_ in ks:
        for x in k:
            if len(x)>=40: docs[x].add(i)
    out={}
    for i,k,ls in ks:
        keep=[l for l,x in zip(ls,k) if not(len(x)>=40 and len(docs[x])>=5 and max(docs[x])!=i)]
        out[i]=(len(ls),len(ls)-len(keep),hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out
def words(rows):
    ws={i:W.findall(t or "") for i,t in rows}; first={}
    for i in sorted(ws):
        w=ws[i]
        for p in range(len(w)-19): first.setdefault(tuple(w[p:p+20]),(i,p))
    out={}
    for i,w in ws.items():
        cov=bytearray(len(w))
        for p in range(len(w)-19):
            if first[tuple(w[p:p+20])]<(i,p): cov[p:p+20]=b"\1"*20
        out[i]=(len(w),sum(cov),hashlib.sha256(" ".join(x for x,c in zip(w,cov) if not c).encode()).hexdigest())
    return out
def bytes50(rows):
    bs={i:(t or "").encode() for i,t in rows}; first={}
    for i in sorted(bs):
        b=bs[i]
        for p in range(len(b)-49): first.setdefault(b[p:p+50],i)
    out={}
    for i,b in bs.items():
        cov=bytearray(len(b))
        for p in range(len(b)-49):
            if first[b[p:p+50]]<i: cov[p:p+50]=b"\1"*50
        runs=sum(1 for k,c in enumerate(cov) if c and (k==0 or not cov[k-1]))
        out[i]=(len(b),sum(cov),runs,hashlib.sha256(bytes(x for x,c in zip(b,cov) if not c)).hexdigest())
    return out
def jac(rows):
    S={}
    for i,t in rows:
        w=W.findall(low(t or "")); S[i]=({tuple(w[k:k+5]) for k in range(max(1,len(w)-4))} if w else set())
    inv=defaultdict(list)
    for i in S:
        for x in S[i]: inv[x].append(i)
    par={i:i for i in S}
    def f(x):
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    for i in S:
        c=Counter()
        for x in S[i]:
            for j in inv[x]:
                if j<i: c[j]+=1
        for j,n in c.items():
            if 100*n>=80*(len(S[i])+len(S[j])-n):
                a,b=f(i),f(j)
                if a!=b: par[max(a,b)]=min(a,b)
    return {i:(len(S[i]),f(i)) for i in S}
def rules(rows):
    out={}
    for i,t in rows:
        t=t or ""; w=W.findall(t); c=Counter(tuple(w[k:k+5]) for k in range(len(w)-4)); cov=set()
        for k in range(len(w)-4):
            if c[tuple(w[k:k+5])]>1: cov.update(range(k,k+5))
        ls=[l for l in t.split("\n") if W.search(l)]
        out[i]=(len(w),sum(map(len,w)),sum(ch in "#*$%&|<>" for ch in t),len(ls)-len(set(ls)),len(cov),len(w)<10 or 100*len(cov)>20*len(w))
    return out
